"""Operator 5, quality rules: base rules on whole texts, then a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import SPACE, let, table, words

BUCKETS = 65536
#: The target multinomial is fitted on at most so many trusted rows, those with the smallest md5 of doc_id.
MAX_TRUSTED = 20_000
#: Ratios are whole micronats, so that sums do not depend on their order.
SCALE = 1_000_000
#: Added to each bucket's count in either multinomial.
PSEUDO = 1.0
#: A document passes with a mean of at least so many nats per n-gram.
THRESHOLD = -0.6
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def base_measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text as a struct; zeros for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    symbols = F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


#: Up to so many different repeated windows, their places are looked up one window at a time.
FEW_WINDOWS = 24


def repeat_words(w: Column) -> Column:
    """How many words lie in a 3-word window that the text has at least twice; w is bound by a lambda."""

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def by_sort(hashes: Column) -> Column:
        spans = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def same(s: Column, x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

        return let(spans, lambda s: covered(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["p"])))

    def twice(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        return let(ordered, lambda o: F.array_distinct(F.filter(o, lambda x, i: F.coalesce(x == F.get(o, i + 1), F.lit(False)))))

    def count(hashes: Column) -> Column:
        def by(again: Column) -> Column:
            places = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i)), lambda p: p.isNotNull())
            return F.when(F.size(again) == 0, F.lit(0)).when(F.size(again) <= FEW_WINDOWS, covered(places)).otherwise(by_sort(hashes))

        return let(twice(hashes), by)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, count)).cast("long")


def ngram_buckets(text: Column) -> Column:
    """Bucket of each unigram and bigram of the tokens (runs of letters and digits, runs of other signs)."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def buckets(t: Column) -> Column:
        single = F.transform(t, lambda x: F.crc32(x) % BUCKETS)
        double = F.transform(t, lambda x, i: F.crc32(F.concat(x, F.lit(" "), F.coalesce(F.get(t, i + 1), F.lit("")))) % BUCKETS)
        return F.concat(single, F.slice(double, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))))

    return let(tokens, buckets)


def bucket_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(ngram_buckets(F.col("text"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """doc_id of at most `most` rows labelled good and not toxic."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def ratios(target: DataFrame, raw: DataFrame) -> DataFrame:
    """One row, one array: log p_target / p_raw of each bucket in order, in 1/SCALE nats; all 0 without target or corpus."""
    spark = target.sparkSession
    both = (
        target.select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("r"))
        .union(raw.select("bucket", F.lit(0).cast("long"), "n"))
        .union(spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long"), F.lit(0).cast("long")))
        .groupBy("bucket")
        .agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    )
    row = both.agg(F.sum("t").alias("nt"), F.sum("r").alias("nr"), F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("rows"))
    ratio = F.transform(
        "rows",
        lambda x: F.when((F.col("nt") == 0) | (F.col("nr") == 0), F.lit(0).cast("long")).otherwise(
            F.round(
                SCALE
                * (
                    F.ln((x["t"] + PSEUDO) / (F.col("nt") + PSEUDO * BUCKETS))
                    - F.ln((x["r"] + PSEUDO) / (F.col("nr") + PSEUDO * BUCKETS))
                )
            ).cast("long")
        ),
    )
    return row.select(ratio.alias("llr"))


#: What with_quality adds; columns of these names in its input give way.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_ngrams", "score_micro", "kept", "_m", "_t", "_llr")


def model(docs: DataFrame, labels: DataFrame | None, max_trusted: int = MAX_TRUSTED) -> Column:
    """The ratios as a scalar subquery, by the n-grams of all documents and of the trusted ones."""
    raw = bucket_counts(docs.select("text"))
    if labels is None:
        target = raw.limit(0)
    else:
        target = bucket_counts(docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels, max_trusted)), "doc_id", "left_semi"))
    return ratios(target, raw).scalar()


def summed(buckets: Column, llr: Column) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.get(llr, b.cast("int")))


def passes(text: Column, llr: Column, threshold: float = THRESHOLD) -> Column:
    """kept of with_quality() as one expression, so that a filter computes each measure once and scores only what the base rules leave."""
    base = let(words(text), lambda w: (F.size(w) >= 50) & (100 * repeat_words(w) <= 50 * F.size(w)))
    score = let(ngram_buckets(text), lambda g: summed(g, llr) >= math.floor(threshold * SCALE) * F.size(g).cast("long"))
    return F.when(base, score).otherwise(F.lit(False))


def with_quality(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """docs with the base measures, base_failed, n_ngrams, score_micro (summed ratio) and kept.

    The raw multinomial counts the n-grams of all documents; the target's those of trusted rows. Both are
    tables of BUCKETS rows, whatever the input. A document is kept if the base rules hold and its
    score_micro is at least threshold * SCALE * n_ngrams; thus equal texts have equal verdicts.
    Null or empty text: all measures 0, base_failed. No trusted rows (or labels None): ratios of 0, the base
    rules decide. Null or repeated doc_ids and any further columns are carried along, one row out for each in.
    """
    llr = model(docs, labels, max_trusted)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], base_measures(F.col("text")).alias("_m"))
    out = out.select("*", *[F.col(f"_m.{k}") for k in measures]).drop("_m")
    totals = F.transform(
        F.array(ngram_buckets(F.col("text"))),
        lambda g: F.struct(
            F.size(g).cast("long").alias("n"),
            summed(g, F.col("_llr")).alias("s"),
        ),
    )
    out = out.withColumn("_llr", llr).withColumn("_t", F.element_at(totals, 1)).drop("_llr")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limit = math.floor(threshold * SCALE)
    return (
        out.withColumn("base_failed", failed)
        .withColumn("n_ngrams", F.col("_t.n"))
        .withColumn("score_micro", F.col("_t.s"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score_micro") >= limit * F.col("n_ngrams")))
        .drop("_t")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_ngrams", "score_micro"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, in the columns that they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # the ratios are a column of their own: a subquery within a lambda would be looked at for every element
    judged = docs.select(row.alias("_row"), F.col("text").alias("_text"), model(docs, table(spark, sf_dir, "labels")).alias("_llr"))
    return judged.filter(passes(F.col("_text"), F.col("_llr"))).select("_row.*")
