"""Postings, term statistics and unit vectors of the articles, made once and stored for the queries that use them several times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans import dialect
from tributary.sources.scratch import kept, removed, sized

#: Terms of fewer documents are in no vector.
LEAST_DF = 10
#: Pages of users in a partition, each of some hundred terms.
PAGES = 4_000


@dataclass
class TextVectors:
    """Stored tables. postings: aid, major, term, tf of all terms; terms: term, df, idf; vec: aid, major, term, x, idf of unit vectors. term is a hash of the word."""

    postings: DataFrame
    terms: DataFrame
    vec: DataFrame

    def drop(self) -> None:
        removed(self.postings, self.terms, self.vec)


def text_vectors(spark: SparkSession, sf_dir: str) -> TextVectors:
    """The views posting, idf and vec of the dialect as tables: texts are split once."""
    found = dialect.run(dialect.Query("SELECT p.aid, r.major, p.term AS word, p.tf FROM posting p JOIN article r ON p.aid = r.aid"), spark, sf_dir)
    postings = kept(found.select("aid", "major", F.xxhash64("word").alias("term"), "tf"), "postings")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = kept(terms.withColumn("idf", 1 + F.log(F.lit(float(n)) / (1 + F.col("df")))), "terms")
    often = kept(terms.filter(F.col("df") >= LEAST_DF), "often")
    # a window in place of a group and a join: the cells of a document move once, and stand together in the table
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf") * F.col("idf")).over(Window.partitionBy("aid")))
    cells = postings.join(sized(often, "term", "idf"), "term").withColumn("norm", norm).filter("norm > 0")
    vec = cells.select("aid", "major", "term", (F.col("tf") * F.sqrt("idf") / F.col("norm")).alias("x"), "idf")
    return TextVectors(postings, terms, kept(vec, "vec"))


def acted(spark: SparkSession, sf_dir: str, vec: DataFrame) -> DataFrame:
    """The rows of vec of articles that somebody acted on, stored."""
    aids = kept(dialect.run(dialect.Query("SELECT DISTINCT aid FROM act WHERE aid IS NOT NULL"), spark, sf_dir), "acted")
    return kept(vec.join(sized(aids, "aid"), "aid", "left_semi"), "acted-vec")


def by_user(rows: DataFrame, buckets: int = 1) -> DataFrame:
    """rows made by kept() with part, a hash of the user, which decides the partition, PAGES rows a partition or so.

    What is then joined by broadcast and grouped by part, user and more moves no more. part is below a multiple of buckets.
    """
    parts = buckets * max(1, -(-rows._rows // (buckets * PAGES)))
    return rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts))).repartition(parts, "part")


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, aid and g, the weight of the page's place, stored."""
    return kept(dialect.run(dialect.Query("SELECT uid, aid, 1 / (1 + ln(rn)) AS g FROM ranked_page WHERE aid IS NOT NULL"), spark, sf_dir), "pages")


def profiles(spark: SparkSession, sf_dir: str, vec: DataFrame) -> DataFrame:
    """uid, term, x: the view profile of the dialect over stored vectors."""
    known = acted(spark, sf_dir, vec.select("aid", "term", "x"))
    weighed = by_user(ranked_pages(spark, sf_dir)).join(sized(known, "aid", "term", "x"), "aid")
    return weighed.groupBy("part", "uid", "term").agg(F.sum(F.col("x") * F.col("g")).alias("x")).drop("part")
