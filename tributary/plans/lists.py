"""An algebra of ranked lists: candidate lists by key are merged, chained, replaced where empty, filtered and cut, and a tree of such steps is one plan.

A ranked list is a DataFrame of key, aid and rn, rn from 1 without gaps in its key, each aid once a key. Every step takes and gives such frames, so steps nest freely; nothing is
executed before the whole tree is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans import dialect

#: Articles of an input list that count in a merge.
DEPTH = 100
#: Stands behind the last place of a shorter rank vector, so that of two that agree the longer comes first.
BEHIND = 1 << 30


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).select("key", "aid", "rn")


@dataclass(frozen=True)
class Ranked:
    """A ranked list, or what a tree of steps makes of some."""

    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, key: str, *order: Column) -> Ranked:
        """From rows of key and aid in the given order; of repeated ones the first counts, rows with a null go."""
        rows = df.filter(F.col(key).isNotNull() & F.col("aid").isNotNull()).withColumnRenamed(key, "key")
        placed = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy(*order, "aid")))
        return cls(_numbered(placed.groupBy("key", "aid").agg(F.min("_rn").alias("_rn")), F.col("_rn")))

    def head(self, n: int) -> Ranked:
        return Ranked(self.rows.filter(F.col("rn") <= n))

    def merge(self, *others: Ranked) -> Ranked:
        """By the sorted places that an article has in the lists, compared one by one; only the first DEPTH of a list count."""
        lists = [self, *others]
        every = reduce(DataFrame.unionByName, [x.rows.filter(F.col("rn") <= DEPTH) for x in lists])
        places = every.groupBy("key", "aid").agg(F.array_sort(F.collect_list("rn")).alias("v"))
        padded = [F.coalesce(F.get("v", F.lit(i)), F.lit(BEHIND)) for i in range(len(lists))]
        return Ranked(_numbered(places, *padded, F.col("aid")))

    def then(self, other: Ranked) -> Ranked:
        """This list, and behind it what only the other has, in its order."""
        both = self.rows.select("key", "aid", F.lit(0).alias("side"), "rn").unionByName(other.rows.select("key", "aid", F.lit(1).alias("side"), "rn"))
        first = both.groupBy("key", "aid").agg(F.min(F.struct("side", "rn")).alias("at"))
        return Ranked(_numbered(first, F.col("at")))

    def otherwise(self, other: Ranked) -> Ranked:
        """This list; for keys that it has nothing for, the other."""
        return Ranked(self.rows.unionByName(other.rows.join(self.rows.select("key").distinct(), "key", "left_anti")))

    def without(self, gone: DataFrame) -> Ranked:
        """But for the (key, aid) in gone; those behind move up."""
        return Ranked(_numbered(self.rows.join(gone.select("key", "aid"), ["key", "aid"], "left_anti"), F.col("rn")))


#: What the trees are made of: lists by article, and articles that a list must not have. An article's own list is that of its readers' other articles, of its subject, or of its session partners.
SOURCES = {
    "subjects": """SELECT a.aid AS key, b.aid, row_number() OVER (PARTITION BY a.aid ORDER BY b.last_t DESC, b.aid) AS place FROM seen a JOIN seen b ON a.cat = b.cat AND a.aid <> b.aid""",
    "partners": """SELECT a.aid AS key, b.aid, row_number() OVER (PARTITION BY a.aid ORDER BY sum(a.w * b.w) DESC, b.aid) AS place FROM session a JOIN session b ON a.sid = b.sid AND a.aid <> b.aid GROUP BY a.aid, b.aid""",
    "likes": """SELECT a.aid AS key, b.aid, row_number() OVER (PARTITION BY a.aid ORDER BY count(*) DESC, b.aid) AS place FROM liked a JOIN liked b ON a.uid = b.uid AND a.aid <> b.aid GROUP BY a.aid, b.aid""",
}
CTES = """seen AS (SELECT aid, cat, last_t FROM (SELECT r.cat, r.aid, max(a.t) AS last_t, row_number() OVER (PARTITION BY r.cat ORDER BY max(a.t) DESC, r.aid) AS k FROM article r JOIN act a ON r.aid = a.aid
        GROUP BY r.cat, r.aid) x WHERE k <= 200),
    session AS (SELECT sid, aid, max(w) AS w FROM act WHERE w > 0 AND aid IS NOT NULL AND t > @NOW - INTERVAL '365' DAY GROUP BY sid, aid),
    liked AS (SELECT DISTINCT uid, aid FROM act WHERE op >= 200 AND aid IS NOT NULL)"""


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, Ranked]:
    frames = {name: dialect.run(dialect.Query(f"SELECT key, aid, place FROM ({sql}) z WHERE place <= {DEPTH}", CTES), spark, sf_dir) for name, sql in SOURCES.items()}
    return {name: Ranked.of(df, "key", F.col("place")) for name, df in frames.items()}


def _named(tree: Ranked) -> DataFrame:
    return tree.rows.select(F.col("key").alias("a0"), "aid", "rn")


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners, subjects and likes merged; the twenty first."""
    s = _sources(spark, sf_dir)
    return _named(s["partners"].merge(s["subjects"], s["likes"]).head(20))


def chained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of likes, then the partners merged with the subjects, without what somebody turned down more often than liked; the twenty first."""
    s = _sources(spark, sf_dir)
    gone = dialect.run(dialect.Query("SELECT aid FROM act WHERE aid IS NOT NULL GROUP BY aid HAVING sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) > sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END)"), spark, sf_dir)
    tree = s["likes"].head(5).then(s["partners"].merge(s["subjects"]))
    hidden = tree.rows.join(gone, "aid").select("key", "aid")
    return _named(tree.without(hidden).head(20))


def fallback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes where an article has any, else partners, else subjects; the ten first."""
    s = _sources(spark, sf_dir)
    return _named(s["likes"].otherwise(s["partners"]).otherwise(s["subjects"]).head(10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (merged_candidates, chained_candidates, fallback_candidates)}


def oracle_sql() -> dict[str, str]:
    lists = CTES + ", " + ", ".join(f"{n} AS (SELECT key, aid, place FROM ({sql}) z WHERE place <= {DEPTH})" for n, sql in SOURCES.items())
    merged = lambda parts: (
        "SELECT key, aid, row_number() OVER (PARTITION BY key ORDER BY "
        + ", ".join(f"coalesce(v[{i}], {BEHIND})" for i in range(1, len(parts) + 1))
        + ", aid) AS rn FROM (SELECT key, aid, list_sort(list(place)) AS v FROM ("
        + " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
        + ") u GROUP BY key, aid) y"
    )
    gone = "SELECT aid FROM act WHERE aid IS NOT NULL GROUP BY aid HAVING sum(CASE WHEN op < 0 THEN 1 ELSE 0 END) > sum(CASE WHEN op >= 100 THEN 1 ELSE 0 END)"
    chain = f"""SELECT key, aid, row_number() OVER (PARTITION BY key ORDER BY side, rn) AS rn FROM (
        SELECT key, aid, 0 AS side, place AS rn FROM likes WHERE place <= 5 UNION ALL
        SELECT key, aid, 1 AS side, rn FROM ({merged(["partners", "subjects"])}) m WHERE NOT EXISTS (SELECT 1 FROM likes l WHERE l.key = m.key AND l.aid = m.aid AND l.place <= 5)) w
        WHERE aid NOT IN ({gone})"""
    fall = """SELECT key, aid, place AS rn FROM likes UNION ALL SELECT key, aid, place AS rn FROM partners WHERE key NOT IN (SELECT key FROM likes)
        UNION ALL SELECT key, aid, place AS rn FROM subjects WHERE key NOT IN (SELECT key FROM likes) AND key NOT IN (SELECT key FROM partners)"""
    made = {"merged_candidates": (merged(["partners", "subjects", "likes"]), 20), "chained_candidates": (chain, 20), "fallback_candidates": (fall, 10)}
    return {n: dialect.text(dialect.Query(f"SELECT key AS a0, aid, CAST(rn AS INT) AS rn FROM ({sql}) t WHERE rn <= {k}", lists)) for n, (sql, k) in made.items()}
