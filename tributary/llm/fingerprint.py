"""Operator 9, document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import let, lower_ascii, table, words

#: A shingle's bin is the leading 8 bits of its 64-bit hash; of each bin's minimum the low 8 bits are stored.
BINS = 256
SHINGLE = 5
#: Probes of an empty bin that are tried one by one before the nearest full bin on its walk is computed.
EARLY = 4
#: Documents in a run of neighbouring ids, and most runs: what the driver sees is one row a run.
RUN, MOST_RUNS = 2000, 65536
#: Odd steps, one for each bin (a rule, not data), and their inverses modulo BINS.
STEPS = [((b * 0x9E3779B1 >> 7) % BINS) | 1 for b in range(1, BINS + 1)]
INVERSES = [pow(s, -1, BINS) for s in STEPS]


def shingle_hashes(text: Column) -> Column:
    """One hash for each run of SHINGLE words in lower case; of all words where there are fewer; none without words."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, F.array(F.xxhash64(w))).otherwise(runs)

    return let(words(lower_ascii(F.coalesce(text, F.lit("")))), hashes)


def minima(text: Column) -> Column:
    """BINS longs, the least hash of each bin after densification; null for a text without words.

    In ascending order the hashes of a bin lie together, so the minima are the firsts of the runs. An empty bin i
    walks i + a * STEPS[i] (mod BINS) for a = 1, 2, ... to the first full bin and takes its minimum: all bins are
    on every walk, and walks of different bins differ, so that the empty bins spread over all full ones.
    """
    steps = F.array(*[F.lit(s) for s in STEPS])
    inverses = F.array(*[F.lit(s) for s in INVERSES])

    def bin_of(h: Column) -> Column:
        return (F.shiftright(h, 56) + 128).cast("int")

    def firsts(o: Column) -> Column:
        return F.filter(o, lambda h, i: F.when(i == 0, F.lit(True)).otherwise(F.shiftright(h, 56) != F.shiftright(F.get(o, i - 1), 56)))

    def densify(least: Column) -> Column:
        def filled(own: Column, at: Column) -> Column:
            def place(i: Column) -> Column:
                step = F.get(steps, i)
                tries = [F.nullif(F.get(at, (i + step * a).bitwiseAND(BINS - 1)), F.lit(0)) for a in range(EARLY + 1)]
                far = F.array_min(F.transform(own, lambda b: ((b - i) * F.get(inverses, i)).bitwiseAND(BINS - 1)))
                return F.coalesce(*tries, F.get(at, (i + step * far).bitwiseAND(BINS - 1)))

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(least, place(i) - 1))

        def places(own: Column) -> Column:
            """For each bin its place in least from 1, or 0: zeros up to each full bin, its place, zeros after the last."""
            upto = F.flatten(
                F.transform(
                    own, lambda b, j: F.concat(F.array_repeat(F.lit(0), b - F.coalesce(F.get(own, j - 1), F.lit(-1)) - 1), F.array(j + 1))
                )
            )
            return F.concat(upto, F.array_repeat(F.lit(0), F.lit(BINS - 1) - F.element_at(own, -1)))

        return let(F.transform(least, bin_of), lambda own: let(places(own), lambda at: filled(own, at)))

    return let(
        F.sort_array(shingle_hashes(text)),
        lambda o: F.when(F.size(o) == 0, F.lit(None).cast("array<bigint>")).otherwise(let(firsts(o), densify)),
    )


def fingerprint(text: Column) -> Column:
    """The low byte of each minimum, eight to a long; null for a text without words."""

    def pack(m: Column) -> Column:
        def eight(j: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(8):
                out = out.bitwiseOR(F.shiftleft(F.get(m, j * 8 + k).bitwiseAND(255), 8 * k))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), eight)

    return let(minima(text), lambda m: F.when(m.isNotNull(), pack(m)))


def printed(packed: Column) -> Column:
    """Hexadecimal; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard estimate of two fingerprints: the part of equal bytes, less the 2**-8 that agree by chance.

    1 if neither text has words, 0 if one has none.
    """

    def equal_bytes(x: Column, y: Column) -> Column:
        t = x.bitwiseXOR(y)  # folded until the lowest bit of each byte tells whether any of its bits is set
        return let(
            t,
            lambda a: let(
                a.bitwiseOR(F.shiftrightunsigned(a, 4)),
                lambda b: let(
                    b.bitwiseOR(F.shiftrightunsigned(b, 2)),
                    lambda c: 8 - F.bit_count(c.bitwiseOR(F.shiftrightunsigned(c, 1)).bitwiseAND(F.lit(0x0101010101010101))),
                ),
            ),
        )

    same = F.aggregate(F.zip_with(a, b, equal_bytes), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / 256
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and packed of each row, and as next_text and next_packed those of the next by descending doc_id (after the last: the first).

    Ids are cut into runs of even width; each run's last row is also dealt to the run after it, so that a window by
    run finds every neighbour and no task holds more than a run. Null ids come last, rows of one id by their text's hash; a
    single row is its own neighbour.
    """
    spark = docs.sparkSession
    seen = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = seen.lo or 0, seen.hi or 0
    runs = max(1, min(MOST_RUNS, -(-seen.n // RUN)))
    width = (hi - lo + 2) // runs + 1
    key = F.coalesce(F.col("doc_id"), F.lit(max(lo - 1, -(2**63))))
    run = F.floor(key / F.lit(width)).cast("long") if width >= 2**62 else F.expr(f"`_key` div {width}") - F.when(F.col("_key") < 0, 1).otherwise(0)
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("_key")).withColumn("_run", run)
    last = sorted(own.groupBy("_run").agg(F.max("_key").alias("k")).collect())
    moved = [(last[i].k, last[(i + 1) % len(last)]._run) for i in range(len(last))]
    ghosts = F.broadcast(spark.createDataFrame(moved, "_key long, _to long"))
    dealt = (
        own.withColumn("packed", fingerprint(F.col("text")))
        .withColumn("_h", F.xxhash64("text"))
        .join(ghosts, "_key", "left")
        .withColumn("_at", F.explode(F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("ghost")), F.struct(F.col("_to").alias("run"), F.lit(True).alias("ghost")))))
        .filter("_at.run IS NOT NULL")
        .select("doc_id", "text", "packed", "_key", "_h", "_at.run", "_at.ghost")
    )
    order = Window.partitionBy("run").orderBy(F.desc("ghost"), "_key", "_h")
    return (
        dealt.withColumn("next", F.lag(F.struct("text", "packed")).over(order))
        .filter("NOT ghost")
        .select("doc_id", "text", "packed", F.col("next.text").alias("next_text"), F.col("next.packed").alias("next_packed"))
    )


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/3) code points replaced by the first as many (or all) of other."""
    n = F.length(text)
    m = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - m), F.substr(other, F.lit(1), m))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_packed", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("packed")).alias("fingerprint"),
        printed(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
