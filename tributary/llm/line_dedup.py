"""Operator 2, line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find; one line stays of each component.

Signatures and the grouping of band keys are numpy in Python workers: the same rules in DataFrame functions took 731 CPU seconds a GB, see README.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import SPACE, arrow_rows, drop_stored, let, small, stored, table
from tributary.llm.components import components

#: Two lines are linked if 100 * intersection >= PERCENT * union of their sets of shingles of K characters; a shorter line equals itself only.
K, PERCENT = 5, 80
#: MinHash of FUNCTIONS over the shingles, dealt into BANDS of ROWS so that each is in two or three bands. By simulation all bands miss a
#: pair with a chance of 0.005 at a similarity of 0.80, 0.002 at 0.82 and 0.0004 at 0.85.
FUNCTIONS, BANDS, ROWS = 60, 24, 6
#: Texts in one Arrow batch, characters hashed at once (a longer line is one lot), and band keys that a worker holds before it hands them
#: on. They bound memory, not results.
BATCH, LOT, HELD = 500, 1 << 16, 1 << 20
#: Lines of one side in one block of the comparison across components.
BLOCK = 2000
_RANDOM = np.random.default_rng(2)
_XOR, _TIMES = (_RANDOM.integers(0, 1 << 32, FUNCTIONS, np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
_DEALT = np.concatenate([_RANDOM.permutation(FUNCTIONS) for _ in range(-(-BANDS * ROWS // FUNCTIONS))])[: BANDS * ROWS].reshape(BANDS, ROWS)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _joined(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lines that follow one another with a character between them, where each starts, and lengths."""
    chars = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    return chars, np.cumsum(lengths + 1) - lengths - 1, lengths


def _lot_keys(lines: list[str]) -> np.ndarray:
    chars, start, lengths = _joined(lines)
    n = len(chars) - K + 1
    x = np.zeros(n + 1, np.uint32)
    for k in range(K):
        x[:n] = (x[:n] ^ chars[k : n + k]) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    # a line's shingles, then those that reach into the next line
    at = np.stack([start, start + lengths - K + 1], 1).ravel()
    least = np.empty((FUNCTIONS, len(lines)), np.uint32)
    y = np.empty_like(x)
    for i in range(FUNCTIONS):
        np.bitwise_xor(x, _XOR[i], out=y)
        np.multiply(y, _TIMES[i], out=y)
        least[i] = np.minimum.reduceat(y, at)[::2]
    out = np.empty((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for i in _DEALT[band]:
            key = (key ^ least[i]) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key * _MIX
    return out


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys of each line of K characters or more; no line holds a line feed."""
    out, i = [np.empty((0, BANDS), np.uint64)], 0
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LOT, "right")))
        out.append(_lot_keys(lines[i:j]))
        i = j
    return np.concatenate(out)


def line_hash(line: str) -> int:
    """What xxhash64() of Spark gives, as an unsigned number."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def _entries(parts: int):
    """Of texts: band keys and hashes of their lines, grouped by key within a worker, in one row for each of so many parts of the keys.

    A group sends on its least line only (with a flag if it has more), the others come out as members with that as their hub, dealt by
    their own hash: a key that many lines share takes one entry from each lot of HELD.
    """
    step = np.uint64(((1 << 64) - 1) // parts + 1 if parts > 1 else (1 << 64) - 1)

    def out(keys: list[np.ndarray], lines: list[np.ndarray]) -> pa.RecordBatch:
        k, h = np.concatenate(keys), np.concatenate(lines)
        order = np.argsort(k)
        k, h = k[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(new, len(k)))
        hub = np.minimum.reduceat(h, new)
        every = np.repeat(hub, size)
        other = np.flatnonzero(h != every)
        several = np.zeros(len(new), bool)
        several[np.searchsorted(new, other, "right") - 1] = True
        rows = []
        cuts = np.searchsorted(k[new], np.arange(1, parts, dtype=np.uint64) * step) if parts > 1 else []
        for part, (a, b, c) in enumerate(zip(np.split(k[new], cuts), np.split(hub, cuts), np.split(several, cuts), strict=True)):
            if len(a):
                rows.append((part, a.tobytes(), b.tobytes(), b"", c.tobytes()))
        where = np.minimum(h[other].view(np.uint64) // step, np.uint64(parts - 1))
        for part in np.unique(where):
            here = other[where == part]
            rows.append((int(part), k[here].tobytes(), h[here].tobytes(), every[here].tobytes(), b""))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "keys", "lines", "hubs", "several"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        lines: list[np.ndarray] = []
        size = 0
        for batch in batches:
            found = dict.fromkeys(y for x in batch.column(0).to_pylist() if x for y in map(_trimmed, x.split("\n")) if len(y) >= K)
            texts = list(found)
            keys.append(band_keys(texts).ravel())
            lines.append(np.repeat(np.fromiter(map(line_hash, texts), np.uint64, len(texts)).view(np.int64), BANDS))
            size += len(keys[-1])
            if size >= HELD:
                yield out(keys, lines)
                keys, lines, size = [], [], 0
        if size:
            yield out(keys, lines)

    return run


def _trimmed(line: str) -> str:
    return line.strip(SPACE)


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part of the keys: bucket, hash and hub of every line that shares its bucket with another."""
    names = ["bucket", "hash", "hub"]
    keys: list[np.ndarray] = [np.empty(0, np.uint64)]
    lines: list[np.ndarray] = [np.empty(0, np.int64)]
    several: list[np.ndarray] = [np.empty(0, bool)]
    for batch in batches:
        for k, h, hub, more in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if hub:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (k, h, hub)], names=names)
            else:
                keys.append(np.frombuffer(k, np.uint64))
                lines.append(np.frombuffer(h, np.int64))
                several.append(np.frombuffer(more, bool))
    k, h, more = map(np.concatenate, (keys, lines, several))
    if not len(k):
        return
    order = np.argsort(k)
    k, h, more = k[order], h[order], more[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(new, len(k)))
    hub = np.minimum.reduceat(h, new)
    kept = np.repeat((np.maximum.reduceat(h, new) != hub) | np.logical_or.reduceat(more, new), size)
    k, h, hub = k[kept].view(np.int64), h[kept], np.repeat(hub, size)[kept]
    for i in range(0, len(k), HELD):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + HELD]) for x in (k, h, hub)], names=names)


def members(docs: DataFrame) -> DataFrame:
    """bucket (one key of one band), hash (of a line) and hub (one line of the bucket) of all distinct lines that share a bucket with another."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(_entries(parts), "part int, keys binary, lines binary, hubs binary, several binary")
    return rows.repartitionById(parts, F.col("part")).mapInArrow(_buckets, "bucket long, hash long, hub long")


def places(docs: DataFrame) -> DataFrame:
    """doc_id, version (of the text), place from 0 and the hash of the trimmed line, of every line that is not blank."""
    text = F.coalesce("text", F.lit(""))
    hashes = F.transform(F.split(text, "\n"), lambda x: let(F.btrim(x, F.lit(SPACE)), lambda y: F.when(y != "", F.xxhash64(y))))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), F.posexplode(hashes).alias("place", "hash")).filter("hash IS NOT NULL")


def line_texts(docs: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """hash and line of the lines in ids: met where the texts are split if the ids can be broadcast, else each read from one place of places(), so that texts move once."""
    if small(ids) is not ids:
        lines = F.transform(F.split("text", "\n"), lambda x: let(F.btrim(x, F.lit(SPACE)), lambda y: F.struct(F.xxhash64(y).alias("hash"), y.alias("line"))))
        return docs.filter("text IS NOT NULL").select(F.inline(lines)).join(small(ids), "hash", "left_semi").groupBy("hash").agg(F.first("line").alias("line"))
    at = found.join(small(ids), "hash", "left_semi").groupBy("hash").agg(*[F.first(c).alias(c) for c in ("doc_id", "version", "place")])
    spots = at.groupBy("doc_id", "version").agg(F.collect_list(F.struct("hash", "place")).alias("spots"))
    spots = stored(spots.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "spots"), "spots")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("version"))
    rows = rows.join(small(spots), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    lines = let(F.split("text", "\n"), lambda x: F.transform("spots", lambda s: F.struct(s["hash"].alias("hash"), F.btrim(F.get(x, s["place"]), F.lit(SPACE)).alias("line"))))
    return rows.select(F.inline(lines)).groupBy("hash").agg(F.first("line").alias("line"))


class Sets:
    """The sets of shingles of some lines, as hashes of 50 bits or more: those of line i are hashes[start[i] : start[i + 1]], ascending."""

    def __init__(self, lines: list[str]):
        chars, start, lengths = _joined(lines)
        n = max(len(chars) - K + 1, 0)
        x = np.zeros(n, np.uint64)
        for k in range(K):
            x = (x ^ chars[k : n + k]) * _MIX
            x ^= x >> np.uint64(32)
        m = np.maximum(lengths - K + 1, 0)
        of = np.repeat(np.arange(len(lines), dtype=np.uint64), m)
        x = x[np.arange(len(of)) + np.repeat(start - np.cumsum(m) + m, m)]
        bits = np.uint64(max(1, len(lines).bit_length()))
        rest = np.uint64(64) - bits
        # a line's number above its hashes, so that one sort does for all lines
        x = (of << rest) | (x >> bits)
        x.sort()
        x = x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]
        self.start = np.searchsorted(x, np.arange(len(lines) + 1, dtype=np.uint64) << rest)
        self.n = np.diff(self.start)
        self.hashes = x & ((np.uint64(1) << rest) - np.uint64(1))

    @functools.cached_property
    def ids(self) -> np.ndarray:
        """hashes as numbers from 0."""
        return np.unique(self.hashes, return_inverse=True)[1].astype(np.int32)  # a block has fewer shingles

    @functools.cached_property
    def mark(self) -> np.ndarray:
        return np.zeros(self.ids.max(initial=0) + 1, bool)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of some lines are linked to line i."""
        n = self.n[i]
        near = others[(100 * np.minimum(n, self.n[others]) >= PERCENT * np.maximum(n, self.n[others])) & (n > 0)]
        if not len(near):
            return near
        own = slice(self.start[i], self.start[i + 1])
        if 4 * len(near) < len(self.n):
            theirs = np.concatenate([self.hashes[self.start[j] : self.start[j + 1]] for j in near])
            mine = self.hashes[own]
            hit = mine[np.minimum(np.searchsorted(mine, theirs), n - 1)] == theirs
            shared = np.add.reduceat(hit, np.cumsum(self.n[near]) - self.n[near], dtype=np.int64)
        else:
            self.mark[self.ids[own]] = True
            upto = np.concatenate([[0], np.cumsum(self.mark[self.ids], dtype=np.int32)])
            shared = upto[self.start[near + 1]] - upto[self.start[near]]
            self.mark[self.ids[own]] = False
        return near[(100 + PERCENT) * shared >= PERCENT * (n + self.n[near])]


def linked_pairs(xs: list[str], ys: list[str]) -> np.ndarray:
    """Whether the lines of each pair are linked; pairs with the same first line are best together."""
    out = np.zeros(len(xs), bool)
    i = 0
    while i < len(xs):
        j, chars, number = i, 0, {}
        while j < len(xs) and (j == i or chars < LOT):
            for line in (xs[j], ys[j]):
                if line not in number:
                    number[line] = len(number)
                    chars += len(line)
            j += 1
        sets = Sets(list(number))
        a, b = (np.array([number[line] for line in side[i:j]]) for side in (xs, ys))
        for x in dict.fromkeys(a.tolist()):
            here = np.flatnonzero(a == x)
            out[i + here] = np.isin(b[here], sets.linked(x, np.unique(b[here])))
        i = j
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b of lines that are linked, by the full sets of both; the texts of all members of a hub meet it in the last join."""
    rows = pairs.join(texts.select(F.col("hash").alias("b"), F.col("line").alias("y")), "b").join(texts.select(F.col("hash").alias("a"), F.col("line").alias("x")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = pa.array(linked_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(linked) for i in (0, 1)], names=["a", "b"])

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _block_links(block: pa.Table) -> pa.Table:
    """Links within a block: in each of its buckets, each left line that is outside the bucket's least component, against the right ones of other components."""
    block = block.sort_by("bucket")
    bucket, hashes, comp, outside, left, right = (block.column(c).to_numpy() for c in ("bucket", "hash", "comp", "outside", "left", "right"))
    _, at, row = np.unique(hashes, return_index=True, return_inverse=True)
    sets = Sets(block.column("line").take(pa.array(at)).to_pylist())
    of = hashes[at]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, end in itertools.pairwise(np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))):
        rights = first + np.flatnonzero(right[first:end])
        for i in first + np.flatnonzero(left[first:end] & outside[first:end]):
            others = rights[(comp[rights] != comp[i]) & (~outside[rights] | (hashes[i] < hashes[rights]))]
            found = of[sets.linked(row[i], row[others])]
            a.append(np.minimum(found, hashes[i]))
            b.append(np.maximum(found, hashes[i]))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between members of one bucket in different components.

    Of two such members one is outside the bucket's least component; so the left side holds those outside only, and a large component of
    copies meets the few that are not in it rather than itself. Both sides of a large bucket are dealt into blocks of about BLOCK lines, each pair of which is
    a group of its own: no task holds a bucket. Buckets of one block go whole, with others of their kind, into groups of about BLOCK lines.
    """
    rest = rest.withColumn("outside", F.col("comp") != F.col("least")).drop("least")
    sides = stored(rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("rights"), F.ceil(F.count_if("outside") / BLOCK).alias("lefts"), F.count("*").alias("n")), "sides")
    lots = -(-(sides.filter("rights = 1").agg(F.sum("n")).first()[0] or 1) // BLOCK)
    numbers = lambda n, body: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), body)
    of = lambda n: F.pmod(F.xxhash64("hash", F.lit(n)), F.col(n))
    group = lambda lot, i, j, left, right: F.struct(lot.alias("lot"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    none = F.lit(-1).cast("long")
    whole = F.array(group(F.pmod(F.xxhash64("bucket"), F.lit(lots)), none, none, True, True))
    lefts = F.when(F.col("outside"), numbers("rights", lambda j: group(F.col("bucket"), of("lefts"), j, True, False)))
    rights = numbers("lefts", lambda i: group(F.col("bucket"), i, of("rights"), False, True))
    dealt = F.when(F.col("rights") == 1, whole).when(F.col("outside"), F.concat(lefts, rights)).otherwise(rights)
    rows = rest.join(small(sides), "bucket").select("bucket", "hash", "comp", "outside", F.inline(dealt))
    return rows.join(texts, "hash").groupBy("lot", "i", "j").applyInArrow(_block_links, "a long, b long").distinct()


def line_components(docs: DataFrame, found: DataFrame) -> DataFrame:
    """hash and root of the lines that are linked to another line. found: places(), stored.

    The lines of a bucket are first compared with its hub; then, where its lines are still in several components, across these.
    """
    near = stored(members(docs), "members")
    ids = stored(near.select("hash").distinct(), "ids")
    texts = stored(line_texts(docs, found, ids), "texts")
    links = stored(_verified(near.filter("hash <> hub").select(F.col("hub").alias("a"), F.col("hash").alias("b")).distinct(), texts), "links")
    roots = stored(components(links, "a", "b").withColumnRenamed("node", "hash"), "roots")
    placed = stored(near.select("bucket", "hash").distinct().join(small(roots), "hash", "left").withColumn("comp", F.coalesce("root", "hash")).drop("root"), "placed")
    # a bucket of two has had its only pair tested
    mixed = stored(placed.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n")).filter("least < most AND n > 2").select("bucket", "least"), "mixed")
    rest = stored(placed.join(small(mixed), "bucket"), "rest")
    more = stored(_across(rest, texts), "across")
    drop_stored(near, ids, texts, placed, mixed, rest)
    if not more.limit(1).count():
        return roots
    return stored(components(links.union(more), "a", "b").withColumnRenamed("node", "hash"), "roots")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version and places (of the lines to drop, ascending), for documents that lose any.

    Equal lines (trimmed) and linked lines are one component; its first line by doc_id (null first), version, place stays. Rows that
    repeat a doc_id with the same text are one document. Equal lines are always found, at any length; a pair of linked lines is missed by all
    bands with a chance of 0.005 at PERCENT, less above. Lines are told apart by 64-bit hashes.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        found = stored(places(docs), "places")
        roots = line_components(docs, found)
    copies = found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash", F.col("hash").alias("root"))
    several = copies.join(small(roots), "hash", "left_anti").union(roots.select("hash", "root"))
    seen = stored(found.join(small(stored(several, "several")), "hash"), "seen")
    first = stored(seen.groupBy("root").agg(F.min(F.struct("doc_id", "version", "place")).alias("first")), "first")
    gone = seen.join(small(first), "root").filter(~F.struct("doc_id", "version", "place").eqNullSafe(F.col("first")))
    out = stored(gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("place")).alias("places")), "gone")
    drop_stored(found, seen, first)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text less the dropped lines, n_lines and n_dropped; other columns are carried along.

    Documents of which nothing is dropped keep their text as it is, null included; from others the dropped lines go, the rest is joined by \\n.
    """
    gone = small(dropped_lines(docs)).select(F.col("doc_id").alias("_gone_id"), F.col("version").alias("_gone_version"), F.col("places").alias("_gone_places"))
    text = F.coalesce("text", F.lit(""))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row's own columns are packed, so that none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_version"))
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_version") == F.col("_gone_version")), "left")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone_places"))
    kept = let(F.split("_text", "\n"), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("_gone_places").isNull(), F.col("_row.text")).otherwise(kept)
    return rows.select(
        *[(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in names],
        (F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone_places"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines, n_chars counted anew; those left without a word that had lines dropped go."""
    names = docs.columns
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in names})
    out = deduplicated(renamed).filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(SPACE)) != ""))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed({f"_own_{c}": c for c in ("n_lines", "n_dropped") if c in names}).select(*[F.col(f"`{c}`") for c in names])
