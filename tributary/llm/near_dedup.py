"""Operator 8, MinHash near-dedup: fast similarity sketches, banding, exact verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow_rows, drop_stored, small, stored, table
from tributary.llm.components import components, dealt_pairs

SHINGLE = 5
#: Two documents are linked if 100 * intersection >= PERCENT * union of their shingle sets.
PERCENT = 75
#: Sketch of BANDS * ROWS coordinates; at a similarity of 0.75 all bands miss a pair with a chance of (1 - 0.75**5)**30 < 0.0003.
BANDS, ROWS = 30, 5
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rounds of random pairing in buckets of several components.
DEALS = 1
#: Texts, or pairs of them, in one Arrow batch.
BATCH = 500
#: Words whose hash a worker remembers before it begins anew.
MOST_WORDS = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MOST_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


WORD_HASH = _WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of 64-bit hashes of the text's shingles, ascending. bytes.split() cuts at the six white space characters and lower() moves A-Z only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORD_HASH.__getitem__, found), np.uint64, n)
    width = min(SHINGLE, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : n - width + 1 + k] * MIX)
    return np.unique(out + np.uint64(width))


def sketch(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch: in round i each element falls into one bin with a value in [i, i + 1), and bins keep their least.

    In the first `size` rounds the bin is a hash's; in `size` more, round size + b puts every element into bin b. So after a
    number of rounds that is about size * ln(size) / len(hashes) all bins are full, after 2 * size surely, and rounds end there.
    """
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    empty = size
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            h = mixed(hashes + MIX * np.uint64(i + 1))
            value = (np.uint64(i) << np.uint64(40)) | (h >> np.uint64(24))
            if i < size:
                np.minimum.at(out, (h & np.uint64(0xFFFFFF)) % np.uint64(size), value)
            else:
                out[i - size] = min(out[i - size], value.min())
            if i or len(hashes) >= size:
                empty = np.count_nonzero(out == np.iinfo(np.uint64).max)
                if not empty:
                    break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 63-bit key for each band; the band's number is part of it."""
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mixed(key ^ rows[:, k])
    return (key >> np.uint64(1)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, version (of the text), n_shingles, hi, lo (128-bit hash of the shingle set) and bands of every row; bands is empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            size, hi, lo, bands = [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(1):
                    s = shingles(text.as_py())
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    size.append(len(s))
                    hi.append((whole >> 64) - 2**63)
                    lo.append((whole & (2**64 - 1)) - 2**63)
                    bands.append(band_keys(sketch(s)) if len(s) else [])
            arrays = [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "version", "n_shingles", "hi", "lo", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("version")).mapInArrow(
        run, "doc_id long, version long, n_shingles long, hi long, lo long, bands array<long>"
    )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and linked of each pair, by the full shingle sets of both texts."""
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            linked = []
            with np.errstate(over="ignore"):
                for key, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if last[0] != key:
                        last = (key, shingles(y.as_py()))
                    p, q = shingles(x.as_py()), last[1]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    linked.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    found = small(stored(components(links, "a", "b"), "roots"))
    return members.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")


def open_sets(texts: DataFrame) -> DataFrame:
    """doc and hashes, the shingle set, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                with np.errstate(over="ignore"):
                    h = pa.array([shingles(text.as_py()).astype(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), h], ["doc", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc long, hashes array<long>")


def _links_across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between members of one bucket that belong to different components, by their full sets within the join.

    Of two such members one is outside the bucket's least component; so the left side holds those outside only, and a large
    component of copies meets the few that are not in it rather than itself. Rows come out for links alone.
    """
    docs = stored(rest.select("doc").distinct(), "open")
    sets = stored(open_sets(texts.join(small(docs).withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")), "sets")
    full = rest.select("bucket", "doc", "comp", "least").join(sets, "doc")
    x, y = full.filter("comp <> least").alias("x"), full.alias("y")
    nx, ny = F.size("x.hashes"), F.size("y.hashes")
    linked = (
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.comp") == F.col("y.least")) | (F.col("x.doc") < F.col("y.doc")))
        & (100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny))
        & ((100 + PERCENT) * F.size(F.array_intersect("x.hashes", "y.hashes")) >= PERCENT * (nx + ny))
    )
    return x.join(y, linked).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """As _near_duplicates, which see; few texts at once go to a Python worker."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text; other columns are not read).

    Equal sets are one class, which goes by a hash of the set (doc from here on) and has one text; the rest works on classes. Those that share a
    band meet in a bucket: first each is verified against the bucket's least member, then, where members of the bucket still
    belong to different components, in DEALS rounds against others drawn at random; last, whoever is outside its bucket's first
    component is compared with all members of other components. Pairs inside a component need no test, so a large group of copies costs
    its size, not its square, and no link between different texts is lost but by a miss of all bands. No cap applies.
    Null or blank text: no shingles, a component of its own. Null doc_id: component null, kept. Rows that repeat a doc_id are
    one document; they link to all that any of them links to.
    """
    found = stored(signatures(docs), "signatures")
    real = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("doc", F.xxhash64("hi", "lo"))
    classes = stored(
        real.groupBy("doc").agg(F.min(F.struct("doc_id", "version")).alias("text_of"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    entries = classes.select("doc", F.explode("bands").alias("bucket"))
    hubs = stored(entries.groupBy("bucket").agg(F.min("doc").alias("low"), F.count("*").alias("size")).filter("size > 1").select("bucket", "low"), "hubs")
    members = stored(entries.join(small(hubs), "bucket"), "members")
    ids = stored(classes.join(small(stored(members.select("doc").distinct(), "met")), "doc", "left_semi").select("doc", "text_of.doc_id", "text_of.version"), "ids")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("version", F.xxhash64("text"))
    texts = stored(rows.join(small(ids), ["doc_id", "version"]).select(F.col("doc").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    pairs = members.filter("doc > low").select(F.col("low").alias("a"), F.col("doc").alias("b")).distinct()
    tested = stored(verified(pairs, texts), "tested")
    links = stored(tested.filter("linked").select("a", "b"), "links")
    for step in range(DEALS + 1):
        placed = stored(_with_components(members, links), "placed")
        open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).filter("least < most AND n > 2")  # the only pair of a bucket of two has been tested
        rest = stored(placed.join(open_buckets.drop("most"), "bucket"), "rest")
        drop_stored(placed)
        if not rest.limit(1).count():
            break
        if step < DEALS:
            pairs = dealt_pairs(rest, "doc", step).join(tested.select("a", "b"), ["a", "b"], "left_anti")
            found_now = verified(pairs, texts).filter("linked").select("a", "b")
        else:
            found_now = _links_across(rest, texts).distinct()
        links = stored(links.union(found_now), "links")
    several = real.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("doc_id", "a")
    same = real.select("doc_id", F.col("doc").alias("b")).join(small(stored(several, "several")), "doc_id").filter("a <> b").select("a", "b").distinct()
    links = links.union(same)
    joined = stored(components(links, "a", "b").select(F.col("node").alias("doc"), F.col("root").alias("comp")), "joined")
    first = classes.filter("n > 1").select("doc", "text_of.doc_id").join(small(joined), "doc", "left_anti").select("doc", F.col("doc_id").alias("root"))
    placed = stored(classes.select("doc", "text_of.doc_id").join(small(joined), "doc"), "placed")
    least = stored(placed.groupBy("comp").agg(F.min("doc_id").alias("root")), "least")
    answers = stored(placed.join(small(least), "comp").select("doc", "root").union(first), "answers")
    roots = small(stored(real.select("doc_id", "doc").join(small(answers), "doc").select("doc_id", "root").distinct(), "roots"))
    return (
        found.select("doc_id", "n_shingles")
        .join(roots, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the least doc_id."""
    gone = stored(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
