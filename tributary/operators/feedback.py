"""Profiles rebuilt from all lists that a user was shown, and profiles seeded by simulated feedback on the user's own articles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.operators.kernels import coin, feedback_coefficients
from tributary.operators.sampling import numbered
from tributary.plans import dialect, packed
from tributary.plans.vectors import acted, by_user, text_vectors
from tributary.sources.scratch import kept, sized

#: Articles of a shown list at most, and of a simulated one.
SHOWN, SIMULATED = 200, 10
#: Terms whose weight is nearer to zero are no part of a profile.
LEAST_WEIGHT = 1e-12


def gamma(j: int) -> float:
    """The weight of place j, from 0."""
    return 1 / (1 + math.log(1 + j))


def list_coefficients(spark: SparkSession, sf_dir: str, first_id: int = 0, below_id: int | None = None) -> DataFrame:
    """uid, list, aid, rho: what each list shown teaches. A user's list of a day has the articles of the actions on it, in the order of the first ones, SHOWN at most.

    Only actions with ids from first_id, and below below_id if given, count. A list's verdicts come from its own actions; a group is one user's lists, as groups cost more than their rows.
    """
    where = f"id >= {first_id}" + (f" AND id < {below_id}" if below_id is not None else "")
    rows = dialect.run(
        dialect.Query(
            f"""SELECT uid, list, aid, place, CASE WHEN judged < 0 THEN 'DEMOTED' WHEN judged >= 100 THEN 'PROMOTED' WHEN views > 0 THEN 'VIEWED' END AS verdict FROM (
            SELECT uid, CAST(t AS DATE) AS list, aid, row_number() OVER (PARTITION BY uid, CAST(t AS DATE) ORDER BY min(id), aid) AS place,
            @LAST(CASE WHEN op < 0 OR op >= 100 THEN op END, CASE WHEN op < 0 OR op >= 100 THEN id END) AS judged, sum(CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 0 END) AS views
            FROM act WHERE aid IS NOT NULL AND {where} GROUP BY uid, CAST(t AS DATE), aid) x WHERE place <= {SHOWN}"""
        ),
        spark,
        sf_dir,
    )

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lists: dict = {}
        ordered = rows.sort_values(["list", "place"])
        for day, aid, verdict in zip(ordered["list"], ordered["aid"], ordered["verdict"], strict=True):
            lists.setdefault(day, []).append((aid, verdict))
        out = []
        for day, own in lists.items():
            rho, _ = feedback_coefficients([a for a, _ in own], {a: v for a, v in own if v}, coin(f"{key[0]}/{day}") == 1)
            out += [(key[0], day, a, r) for a, r in rho.items() if r]
        return pd.DataFrame(out, columns=["uid", "list", "aid", "rho"])

    return rows.groupBy("uid").applyInPandas(learn, "uid long, list date, aid long, rho double")


def rebuilt_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's profile after every list, in the order of lists: of each term that a list moved, the weight then.

    An update adds coefficients times vectors, so the state after a list is the sum over the lists up to it: a running sum by user and term, which
    holds no user's history together.
    """
    made = text_vectors(spark, sf_dir)
    known = acted(spark, sf_dir, made.vec.select("aid", "term", "x"))
    moved = by_user(kept(list_coefficients(spark, sf_dir), "moved")).join(sized(known, "aid", "term", "x"), "aid")
    moves = moved.groupBy("part", "uid", "list", "term").agg(F.sum(F.col("rho") * F.col("x")).alias("step"))
    so_far = F.sum("step").over(Window.partitionBy("part", "uid", "term").orderBy("list").rowsBetween(Window.unboundedPreceding, 0))
    return moves.select("uid", "list", "term", F.round(so_far, 9).alias("w"))


def packed_vector(numbers: np.ndarray, tfs: np.ndarray) -> bytes:
    """Ascending numbers of terms, as differences, and their frequencies: three bytes a term for all but odd vectors."""
    steps = np.diff(numbers, prepend=0)
    wide, long = bool((steps > 0xFFFF).any()), bool((tfs > 0xFF).any())
    return bytes([wide | long << 1]) + steps.astype(np.uint32 if wide else np.uint16).tobytes() + tfs.astype(np.uint32 if long else np.uint8).tobytes()


def unpacked_vector(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, tf = np.dtype(np.uint32 if cell[0] & 1 else np.uint16), np.dtype(np.uint32 if cell[0] & 2 else np.uint8)
    n = (len(cell) - 1) // (step.itemsize + tf.itemsize)
    return np.cumsum(np.frombuffer(cell, step, n, 1), dtype=np.int64), np.frombuffer(cell, tf, n, 1 + n * step.itemsize).astype(float)


def simulate(terms: np.ndarray, idfs: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """uid, term, w from rows sorted by uid, round and place: each a list's article with its packed vector over terms; the last place is the user's own article.

    A round ranks its list by the profile so far, ties as they stand; the user is taken to read down to their own article and to want it first: what stands
    above sinks by one place, their own rises to the top, and the profile moves by the differences of the places' weights. Only a profile and a list are held.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid, at, held = None, None, []
        profile, touched = np.zeros(len(terms)), []

        def learn() -> None:
            vectors = []
            for cell in held:
                numbers, tfs = unpacked_vector(cell) if cell is not None else (np.zeros(0, np.int64), np.zeros(0))
                idf = idfs[numbers]
                x = tfs * np.sqrt(idf)
                vectors.append((numbers, x / max(np.sqrt(x @ x), 1e-300), idf))
            order = sorted(range(len(held)), key=lambda i: (-round(float((vectors[i][1] * vectors[i][2]) @ profile[vectors[i][0]]), 12), i))
            for j, i in enumerate(order):
                own = i == len(held) - 1
                numbers, x, _ = vectors[i]
                profile[numbers] += (gamma(0 if own else j + 1) - gamma(j)) * x
                touched.append(numbers)
                if own:
                    break
            held.clear()

        def result() -> pd.DataFrame:
            found = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
            w = profile[found]
            profile[found] = 0.0
            touched.clear()
            far = np.abs(w) >= LEAST_WEIGHT
            return pd.DataFrame({"uid": np.full(far.sum(), uid), "term": terms[found[far]], "w": w[far]})

        for batch in rows:
            done = []
            for r in batch.itertuples(index=False):
                if (r.uid, r.round) != at:
                    if held:
                        learn()
                    if r.uid != uid:
                        if uid is not None:
                            done.append(result())
                        uid = r.uid
                    at = (r.uid, r.round)
                held.append(r.v)
            if done:
                yield pd.concat(done)
        if held:
            learn()
        if uid is not None:
            yield result()

    return run


def simulated_lists(spark: SparkSession, sf_dir: str, length: int = SIMULATED) -> DataFrame:
    """uid, round, place, aid: of each user and each article that they took, in the order of taking, length - 1 drawn articles and then their own.

    Draws are hashes of user, round and place over the numbers of all articles; one drawn twice, or the user's own, is left out.
    """
    taken = dialect.run(dialect.Query("SELECT uid, aid, min(id) AS id FROM act WHERE kind = 'purchase' AND aid IS NOT NULL GROUP BY uid, aid"), spark, sf_dir)
    rounds = taken.withColumn("round", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).select("uid", "round", F.col("aid").alias("own"))
    pool = numbered(dialect.run(dialect.Query("SELECT aid FROM article WHERE aid IS NOT NULL"), spark, sf_dir).distinct(), "aid", "number")
    n = pool.count()
    drawn = rounds.select("uid", "round", "own", F.explode(F.sequence(F.lit(1), F.lit(length - 1))).alias("place")).withColumn("number", F.pmod(F.xxhash64("uid", "round", "place"), F.lit(max(n, 1))) + 1)
    drawn = drawn.join(pool, "number").filter("aid <> own").groupBy("uid", "round", "aid").agg(F.min("place").alias("place")).select("uid", "round", "place", "aid")
    return drawn.unionByName(rounds.select("uid", "round", F.lit(length).alias("place"), F.col("own").alias("aid")))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """aid and v, the packed vector, of rows of packed articles."""
    for batch in batches:
        cells = packed.frequencies(pa.Table.from_batches([batch]))
        rows = zip(cells.starts, cells.starts[1:])
        yield pa.RecordBatch.from_arrays([batch.column("aid"), pa.array([packed_vector(cells.cols[a:b].astype(np.int64), cells.x[a:b].astype(np.int64)) for a, b in rows], pa.binary())], ["aid", "v"])


def seeded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all users from simulated feedback on lists of drawn articles with one of theirs in each."""
    made = packed.articles(spark, sf_dir)  # 16 bytes a term that ten documents share; all tasks have them
    vectors = made.rows.select("aid", "steps", "tfs").mapInArrow(_vectors, "aid long, v binary")
    rows = simulated_lists(spark, sf_dir).join(vectors, "aid", "left").select("uid", "round", "place", "v")
    rows = rows.repartition("uid").sortWithinPartitions("uid", "round", "place")
    return rows.mapInPandas(simulate(made.terms, made.idf), "uid long, term long, w double").withColumn("w", F.round("w", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (rebuilt_profiles, seeded_profiles)}
