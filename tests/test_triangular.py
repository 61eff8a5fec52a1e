import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import bandits
from tributary.plans import catalogue
from tributary.plans.dialect import Query, run
from tributary.sources import triangular as t

DIR = "/root/testdata/sf0.001"
N, DEPTH = 7, 2


def table(spark):
    rows = [(0.99, xi, 1.0, 1.0, i, j, [xi + i / 10 + j / 100 + u / 1000 for u in range(DEPTH + 1)]) for xi in (0.1, 0.5) for i in range(N + 1) for j in range(N + 1 - i)]
    return spark.createDataFrame(rows, t.SCHEMA), rows


def test_round_trip_is_exact_and_rows_stand_where_their_counts_say(spark, tmp_path):
    df, rows = table(spark)
    made = t.write(df.repartition(4), f"file://{tmp_path}/x", N, DEPTH).collect()
    assert sorted(r.name for r in made) == sorted(os.listdir(f"{tmp_path}/x")) == [f"gamma0_0.990_xi0_{x}_alpha0_1.00_beta0_1.00.bin" for x in ("0.10", "0.50")]
    with open(f"{tmp_path}/x/gamma0_0.990_xi0_0.50_alpha0_1.00_beta0_1.00.bin", "rb") as file:
        data = file.read()
    assert len(data) == 4 * 36 * 3 == made[0].bytes
    for at, (i, j) in enumerate((i, j) for i in range(N + 1) for j in range(N + 1 - i)):
        assert t.place(i, j, N) == at
        assert struct.unpack(">3f", data[12 * at : 12 * at + 12]) == pytest.approx([0.5 + i / 10 + j / 100 + u / 1000 for u in range(3)])
    back = t.read(spark, f"file://{tmp_path}/x", N, DEPTH)
    bits = lambda rows: sorted((*r[:6], np.array(r[6], "f4").tobytes()) for r in rows)
    assert bits(back.collect()) == bits(rows)
    assert t.parameters(f"{tmp_path}/x") == [(0.99, 0.1, 1.0, 1.0), (0.99, 0.5, 1.0, 1.0)]


def test_filters_on_the_first_count_narrow_what_is_read(spark, tmp_path):
    t.write(table(spark)[0], str(tmp_path), N, DEPTH).collect()
    reader = t._Reader({"path": str(tmp_path), "n": str(N), "depth": str(DEPTH)})
    rest = list(reader.pushFilters([t.EqualTo(("i",), 3), t.EqualTo(("j",), 1)]))
    assert len(rest) == 1 and sum(p.high - p.low for p in reader.partitions()) == 2 * (N + 1 - 3)
    assert t.read(spark, str(tmp_path), N, DEPTH).filter("i = 3").count() == 10
    assert t.read(spark, str(tmp_path), N, DEPTH).filter("i = 99").count() == 0


@pytest.mark.parametrize("spoil", ["missing", "repeated", "null", "short"])
def test_tables_that_are_not_whole_leave_no_file(spark, tmp_path, spoil):
    df, rows = table(spark)
    bad = {
        "missing": df.filter("NOT (i = 2 AND j = 1)"), "repeated": df.union(df.filter("i = 2 AND j = 1")),
        "null": df.withColumn("values", F.when(F.col("i") == 2, F.transform("values", lambda v: F.lit(None).cast("float"))).otherwise(F.col("values"))), "short": df.withColumn("values", F.slice("values", 1, 2)),
    }
    with pytest.raises(Exception, match="missing, repeated|are due"):
        t.write(bad[spoil], str(tmp_path / "y"), N, DEPTH).collect()
    assert not [x for x in os.listdir(tmp_path / "y") if x.endswith(".bin")]


def test_files_of_another_size_are_refused(spark, tmp_path):
    t.write(table(spark)[0], str(tmp_path), N, DEPTH).collect()
    with pytest.raises(Exception, match="bytes"):
        t.read(spark, str(tmp_path), N + 1, DEPTH).count()


def test_text_becomes_the_same_table(spark, tmp_path):
    _, rows = table(spark)
    lines = [",  ".join(map(str, r[6])) for r in rows if r[1] == 0.1]
    text = spark.createDataFrame(list(enumerate(lines)), "place long, value string")
    got = t.from_text(text, (0.99, 0.1, 1.0, 1.0), N)
    assert sorted((r.i, r.j, tuple(r["values"])) for r in got.collect()) == sorted((r[4], r[5], tuple(np.array(r[6], "f4").tolist())) for r in rows if r[1] == 0.1)
    big = 1000
    at = spark.range(0, t.rows_of(big), 97).select(F.col("id").alias("place"), F.lit("1").alias("value"))
    assert all(t.place(r.i, r.j, big) % 97 == 0 and 0 <= r.j <= big - r.i for r in t.from_text(at, (1, 1, 1, 1), big).select("i", "j").collect())


def test_lookup_seeks_and_scales(spark, tmp_path):
    df, rows = table(spark)
    t.write(df, str(tmp_path), N, DEPTH).collect()
    states = [(0.99, 0.1, 1.0, 1.0, 3, 2), (0.99, 0.1, 1.0, 1.0, 3, 2), (0.99, 0.5, 1.0, 1.0, 60, 10), (0.99, 0.5, 1.0, 1.0, 0, 99), (0.99, 0.7, 1.0, 1.0, 1, 1)]
    got = {(r.xi, r.i, r.j): r["values"] for r in t.lookup(spark.createDataFrame(states, "gamma double, xi double, alpha0 double, beta0 double, i int, j int"), str(tmp_path), N, DEPTH).collect()}
    want = {(0.1, 3, 2): (0.1, 3, 2), (0.5, 60, 10): (0.5, 6, 1), (0.5, 0, 99): (0.5, 0, 7)}
    assert got.keys() == want.keys()
    for at, (xi, i, j) in want.items():
        assert got[at] == pytest.approx([xi + i / 10 + j / 100 + u / 1000 for u in range(3)])


def test_queued_lists_match_a_plain_lookup(spark):
    n, depth = 40, 3
    got = bandits.queued_lists(spark, DIR, horizon=n, depth=depth, days=20).collect()
    q = lambda sql: run(Query(sql), spark, DIR).collect()
    dates = q("SELECT r.aid, r.cat, min(a.t) AS seen FROM article r JOIN act a ON r.aid = a.aid GROUP BY r.aid, r.cat HAVING min(a.t) > @NOW - INTERVAL '20' DAY")
    cats = {}
    for r in sorted(dates, key=lambda r: r.aid):
        cats.setdefault(r.cat, []).append((r.seen, r.aid))
    for own in cats.values():
        own.sort(key=lambda x: (-x[0].timestamp(), x[1]))
    costs = {(x, u): {m: c for m, c in bandits.forwarding_costs(bandits.GAMMA ** (1 + u * x), n)} for x in bandits.SHARES for u in range(depth + 1)}
    want = {}
    for r in run(catalogue.QUERIES["alpha_beta"], spark, DIR).collect():
        if r.cat not in cats:
            continue
        i, j = r.alpha - 1, r.beta - 1
        if i + j > n:
            i = math.floor(i / (i + j) * n + 0.5)
            j = n - i
        share = 1 / (1 + len(cats[r.cat]) / 20)
        for place, (seen, aid) in enumerate(cats[r.cat], 1):
            u = min(place, depth)
            s = float(np.interp(share, bandits.SHARES, [np.float32(costs[x, u][i + j][i]) for x in bandits.SHARES]))
            want.setdefault(r.uid, []).append((round(s, 6), seen, aid))
    lists = {}
    for r in got:
        lists.setdefault(r.uid, []).append(r)
    assert lists.keys() == want.keys() and len(got) > 10
    for uid, own in want.items():
        own.sort(key=lambda x: (-x[0], -x[1].timestamp(), x[2]))
        mine = sorted(lists[uid], key=lambda r: r.rn)
        assert [r.rn for r in mine] == list(range(1, min(len(own), bandits.MOST) + 1))
        assert [r.score for r in mine] == pytest.approx([x[0] for x in own[: len(mine)]], abs=2e-6)
