import datetime as dt
import hashlib
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tributary.llm import time_layout

T0 = dt.datetime(1970, 1, 1)


def moment(ts, click_id):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def plain_leaves(moments, most):
    """[(leaf, first moment, end)] by recursion over the calendar."""
    out = []

    def members(level, start):
        if level == 2:
            return [dt.datetime(start.year, m, 1) for m in range(1, 13)]
        if level == 3:
            days = [start + dt.timedelta(days=i) for i in range(31)]
            return [d for d in days if d.month == start.month]
        return [start + dt.timedelta(hours=i) for i in range(24)]

    def after(level, start):
        if level == 1:
            return dt.datetime(start.year + 1, 1, 1)
        if level == 2:
            return dt.datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
        return start + dt.timedelta(days=1) if level == 3 else start + dt.timedelta(hours=1)

    def name(level, parents, a, b):
        form = {1: "%Y", 2: "%m", 3: "%d", 4: "%H"}[level]
        return "/".join([*parents, f"{a.strftime(form)}-{b.strftime(form)}"])

    def split(level, starts, inside, parents):
        runs = []
        for s in starts:
            own = [m for m in inside if s <= m < after(level, s)]
            if runs and runs[-1][2] + len(own) <= most:
                runs[-1][1], runs[-1][2] = s, runs[-1][2] + len(own)
            else:
                runs.append([s, s, len(own)])
            if len(own) > most and level < 4:
                split(level + 1, members(level + 1, s), own, [*parents, s.strftime({1: "%Y", 2: "%m", 3: "%d"}[level])])
        out.extend((name(level, parents, a, b), a, after(level, b)) for a, b, n in runs if n and (n <= most or level == 4))

    some = [m for m in moments if m is not None]
    if some:
        split(1, [dt.datetime(y, 1, 1) for y in range(min(some).year, max(some).year + 1)], some, [])
    return out


def plain_files(rows, most):
    """{(leaf, part): [(click_id, arrived_at)]}."""
    keyed = [(moment(r["ts"], r["click_id"]), r["arrived_at"], r["click_id"]) for r in rows]
    found = plain_leaves([k[0] for k in keyed], most)
    files = {}
    for leaf, a, b in [*found, ("null", None, None)]:
        own = [k for k in keyed if (k[0] is None if a is None else k[0] is not None and a <= k[0] < b)]
        own.sort(key=lambda k: tuple((x is not None, x if x is not None else 0) for x in k))
        for i in range(0, len(own), most):
            files[leaf, i // most + 1] = own[i : i + most]
    return files


def ids(own):
    return hashlib.sha256(",".join("" if k[2] is None else str(k[2]) for k in own).encode()).hexdigest()


def expected(rows, most, early):
    old = plain_files([r for r in rows if early(r["arrived_at"])], most)
    return {
        at: (len(own), sum(not early(k[1]) for k in own), ids(own), not (at in old and old[at] == own))
        for at, own in plain_files(rows, most).items()
    }


def made(n, seed, hot=0.3):
    rng = random.Random(seed)
    base, rows = dt.datetime(2024, 3, 29), []
    for i in range(n):
        ts = dt.datetime(2024, 4, 3, 7, 0, 5) if rng.random() < hot else base + dt.timedelta(seconds=rng.randint(0, 40 * 86400))
        arrived = ts + dt.timedelta(seconds=rng.choice([1, 1, 2, 9 * 86400]))
        rows.append({"click_id": i, "ts": None if rng.random() < 0.02 else ts, "arrived_at": None if rng.random() < 0.01 else arrived, "first": "x", "Part": i % 7, "row": None, "n": "y,z", "moment": 1.5})
    return rows + rows[: n // 20]


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, first string, Part long, row string, n string, moment double"


def query(spark, tmp_path, rows, cutoff, schema=SCHEMA):
    at = f"{tmp_path}/in"
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema).write.parquet(f"{at}/clicks.parquet")
    got = time_layout.op13_time_partitions(spark, at, cutoff=cutoff, folder=lambda s: f"{tmp_path}/out")
    return {(r.leaf, r.part): r for r in got.collect()}, names


@pytest.mark.parametrize("n, shares, seed", [(1200, 40, 1), (300, 7, 3), (1, 500, 4), (0, 500, 5)])
def test_layout_matches_brute_force(spark, tmp_path, monkeypatch, n, shares, seed):
    """Late rows, ties, repeated rows, nulls in every column, an hour far above the limit, column names of the operator's own."""
    monkeypatch.setattr(time_layout, "SHARES", shares)
    rows = made(n, seed)
    most = 1 + len(rows) // shares
    edge = dt.datetime(2024, 4, 20)
    got, names = query(spark, tmp_path, rows, str(edge))
    want = expected(rows, most, lambda a: a is not None and a < edge)
    assert {k: (r.n_rows, r.n_new, r.ids_sha256, r.rewritten) for k, r in got.items()} == want
    there = {os.path.join(d, f) for d, _, files in os.walk(f"{tmp_path}/out") for f in files if f.endswith(".parquet")}
    assert {r.path for r in got.values()} == there
    files = plain_files(rows, most)
    for at, r in got.items():
        held = pq.ParquetFile(r.path).read()
        assert held.column_names == names == r.columns.split(",")
        assert held.column("click_id").to_pylist() == [k[2] for k in files[at]]
    if n == 300:
        assert any(leaf[:4] != leaf[5:] for leaf, _ in got if len(leaf) == 9)
    if n == 1200:
        assert {False, True} == {r.rewritten for r in got.values()} and any(r.part > 2 for r in got.values())


def test_query_on_a_table_matches_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/clicks.parquet").select("click_id", "ts", "arrived_at").collect()]
    got = time_layout.op13_time_partitions(spark, "/root/testdata/sf0.001", cutoff="2024-03-10 00:00:00").collect()
    want = expected(rows, 1 + len(rows) // 500, lambda a: a is not None and a < dt.datetime(2024, 3, 10))
    assert {(r.leaf, r.part): (r.n_rows, r.n_new, r.ids_sha256, r.rewritten) for r in got} == want
    assert all(r.columns == "click_id,ts,arrived_at,client_id,kind,value,props" for r in got)


def test_all_rows_at_one_moment_are_cut_by_rank_over_several_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("click_id"), F.lit(dt.datetime(2024, 2, 1, 5)).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("level"))
    layout = time_layout.Layout(f"{tmp_path}/one", 400, F.col("ts"), ["click_id"], F.lit(True))
    files = layout.update(rows)
    got = sorted((r.part, r.n_rows) for r in files.collect())
    assert got == [(i, 400) for i in range(1, 13)] + [(13, 200)]
    first = {r.part: r for r in layout.digests(rows, files, "click_id").collect()}
    assert first[7].ids_sha256 == hashlib.sha256(",".join(map(str, range(2400, 2800))).encode()).hexdigest()
    again = time_layout.Layout(f"{tmp_path}/one", 400, F.col("ts"), ["click_id"], F.lit(False)).update(rows, files)
    assert not again.filter("rewritten").count()


def test_no_moments_at_all(spark, tmp_path):
    rows = [{"click_id": i, "ts": None, "arrived_at": None} for i in range(12)]
    got, _ = query(spark, tmp_path, rows, "2024-05-01 00:00:00", "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz")
    assert len(got) == 12 and {leaf for leaf, _ in got} == {"null"} and all(r.rewritten and r.n_new == 1 for r in got.values())
