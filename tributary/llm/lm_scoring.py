"""Operator 1, LM scoring: stupid backoff over n-gram count tables partitioned by hash, joined to exploded n-grams, summed per document.

Words are hashed in numpy. A lot of texts hands on, to the part of its hash, each distinct n-gram with its count in the lot and the documents
that hold it; there the counts add up, and the documents' n-grams are joined to them. So counting and looking up take one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import SPACE, arrow_rows, drop_stored, small, stored, table

ALPHA = 0.4
#: An n-gram with a share of 1 / HOT or more of a lot's words, and LEAST occurrences in it, is hot there: its documents are not sent to where it
#: is counted (one task), they are joined to its count afterwards. This spreads work and changes no result.
HOT, LEAST = 1 << 10, 64
#: Scores are sums of whole micronats: they do not depend on the order of summing.
SCALE = 1_000_000
#: Texts sent at once to a Python worker, and words and texts of one lot. They bound memory, not results.
BATCH = 500
HELD, MOST_TEXTS = 1 << 20, 1 << 16

#: Bytes whose words are hashed at once (a longer word is one lot); bounds memory.
LOT = 1 << 20
_BLANK = np.isin(np.arange(256), [ord(c) for c in SPACE])
#: A word's hash is the sum of a random number for each byte times a power of BASE for its place, modulo 2**64, mixed with its length.
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


_UP, _DOWN = _powers(_BASE, LOT + 1), _powers(pow(_BASE, -1, 1 << 64), LOT + 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one text after the other, and how many each text has (null: none)."""
    flat = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(flat), np.int64)
    inside = ~_BLANK[data]
    fresh = np.zeros(len(data) + 1, bool)  # where a text starts or the last one ends
    fresh[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(stop, low + LOT, "right")))
        lot = data[low : stop[j - 1]]
        up = _UP if len(lot) < len(_UP) else _powers(_BASE, len(lot))
        sums = np.zeros(len(lot) + 1, np.uint64)
        np.cumsum(_BYTES[lot] * up[: len(lot)], out=sums[1:])
        out[i:j] = (sums[stop[i:j] - low] - sums[start[i:j] - low]) * _DOWN[start[i:j] - low]
        i = j
    out += (stop - start).astype(np.uint64)
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out.view(np.int64), np.diff(np.searchsorted(start, ends))


def pair_hashes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of words."""
    with np.errstate(over="ignore"):
        x = v.view(np.uint64) + np.uint64(_BASE)
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) + w.view(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def micro(n: np.ndarray) -> np.ndarray:
    """ln n in whole micronats; 0 for n = 0, which counts as 1."""
    return np.floor(SCALE * np.log(np.maximum(n, 1).astype(np.float64)) + 0.5).astype(np.int64)


def _planes(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte, so that the shuffle can compress them."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


#: What a lot hands on. kind 0: n-grams of one part (hashes, counts, whether hot, the words of a pair, how many of its documents follow, which of
#: uids they are, and times; negative times for words); 1: the same for hot ones; 2: its documents (uids, doc_ids in keys, words in n).
PARCEL = {"part": pa.int32(), "kind": pa.int32(), **{k: pa.binary() for k in ("keys", "n", "hot", "v", "w", "lens", "owners", "times", "uids")}}
PARCEL_TYPE = "part int, kind int, keys binary, n binary, hot binary, v binary, w binary, lens binary, owners binary, times binary, uids binary"


def _parcels(parts: int, count: bool, score: bool, most: int) -> Callable:
    """Of uid, doc_id and text: PARCEL rows; their n-grams are counted, or looked up, or both."""
    step = np.uint64(((1 << 64) - 1) // parts + 1 if parts > 1 else (1 << 64) - 1)

    def out(words: np.ndarray, lengths: np.ndarray, uids: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple] = []
        total = len(words)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        inside = np.flatnonzero(owner[:-1] == owner[1:]).astype(np.int32)
        v, w = words[inside], words[inside + 1]
        keys = np.concatenate([words, pair_hashes(v, w)]).view(np.uint64)
        order = np.argsort(keys).astype(np.int32)  # a lot has fewer n-grams
        keys = keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        new = np.flatnonzero(fresh)
        number = np.empty(len(keys), np.int32)
        number[order] = np.cumsum(fresh, dtype=np.int32) - 1
        first = order[new]  # where each n-gram occurs
        grams, n = keys[new], np.diff(np.append(new, len(keys)))
        del keys, order, fresh, new
        of_pair = first >= total
        none = np.zeros(0, np.int64)
        starts, gram_owner, times = np.zeros(len(grams) + 1, np.int64), none, none
        hot = (n * HOT >= total) & (n >= LEAST)

        def pair_words(at) -> list[bytes]:
            """The words of pairs that the corpus may not have; 0 and 0 for words."""
            if count:
                return [b"", b""]
            spot, pair = np.maximum(first[at] - total, 0), of_pair[at]
            return [np.where(pair, x[spot] if len(x) else 0, 0).astype(np.int64).tobytes() for x in (v, w)]

        if score:
            # a text scores its pairs less the words inside it; one word alone scores itself
            last = np.cumsum(lengths) - 1
            ends = np.zeros(total, bool)
            ends[(last - lengths + 1)[lengths > 0]] = True
            ends[last[lengths > 0]] = True
            inner = np.flatnonzero(~ends)
            codes = np.concatenate([number[total:].astype(np.int64) << 16 | owner[inside], number[inner].astype(np.int64) << 16 | owner[inner]])
            codes.sort()
            change = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
            at = np.flatnonzero(change)
            times, codes = np.diff(np.append(at, len(codes))).astype(np.int32), codes[at]
            del change, at, inner, ends
            times = np.where(of_pair[codes >> 16], times, -times)
            alone = np.flatnonzero(lengths == 1)
            single = np.sort(number[last[alone]].astype(np.int64) << 16 | alone)
            place = np.searchsorted(codes, single)
            codes, times = np.insert(codes, place, single), np.insert(times, place, 1)
            starts = np.searchsorted(codes, np.arange(len(grams) + 1) << 16)
            gram_owner = (codes & 0xFFFF).astype(np.uint16)
            rows.append((0, 2, ids.tobytes(), lengths.astype(np.int64).tobytes(), b"", b"", b"", b"", b"", b"", uids.tobytes()))
            warm = np.flatnonzero(np.repeat(hot, np.diff(starts)))
            by = warm[np.argsort(gram_owner[warm], kind="stable")]
            if len(by):
                of = codes[by] >> 16
                rows.append((0, 1, grams[of].tobytes(), b"", b"", *pair_words(of), b"", b"", times[by].astype(np.int32).tobytes(), uids[gram_owner[by]].tobytes()))
        lens = np.diff(starts)
        sent = np.where(hot, 0, lens)
        cold = np.repeat(~hot, lens)
        gram_owner, times = gram_owner[cold], times[cold]
        upto = np.concatenate([[0], np.cumsum(sent)])
        cuts = np.searchsorted(grams, np.arange(1, parts, dtype=np.uint64) * step) if parts > 1 else none
        bounds = np.concatenate([[0], cuts, [len(grams)]]).astype(np.int64)
        for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a == b:
                continue
            here, which = np.unique(gram_owner[upto[a] : upto[b]], return_inverse=True)
            rows.append((
                part, 0, _planes(grams[a:b]), (n[a:b] if count else np.zeros(b - a, np.int64)).astype(np.int32).tobytes(), hot[a:b].tobytes(), *pair_words(slice(a, b)),
                sent[a:b].astype(np.uint16 if len(lengths) < 1 << 16 else np.uint32).tobytes(), which.astype(np.uint16).tobytes(), times[upto[a] : upto[b]].astype(np.int32).tobytes(), uids[here].tobytes(),
            ))
        spread = int(xxhash.xxh32_intdigest(uids.tobytes()))
        rows = [(spread % parts if r[1] else r[0], *r[1:]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(PARCEL.values())], names=list(PARCEL))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = texts = 0
        for batch in batches:
            words, lengths = word_hashes(batch.column(2))
            uid = batch.column(0).to_numpy()
            ids = batch.column(1)
            # a null doc_id goes as the least long
            held.append((words, lengths, uid, ids.fill_null(-(2**63)).to_numpy()))
            size, texts = size + len(words), texts + len(lengths)
            if size >= most or texts + BATCH >= MOST_TEXTS:
                yield out(*map(np.concatenate, zip(*held, strict=True)))
                held, size, texts = [], 0, 0
        if held:
            yield out(*map(np.concatenate, zip(*held, strict=True)))

    return run


SUM_NAMES = ["kind", "uid", "doc_id", "key", "n", "s"]
SUM_TYPE = "kind int, uid long, doc_id long, key long, n long, s long"


def _sum_rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(rows, pa.int64()) for c in SUM_NAMES[1:]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *arrays], names=SUM_NAMES)


def _resolved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all parcels of one part: sums by document (kind 0), hot n-grams of documents (1; doc_id and s are the words of
    a pair that the corpus may not have), documents (2), counts of hot n-grams (3) and pairs of documents that the corpus
    does not have (4; key and s are the words)."""
    grams: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, len(PARCEL))), strict=True):
            kind, keys, n, hot, v, w, lens, owners, times, uids = row
            if kind == 2:
                yield _sum_rows(2, uid=np.frombuffer(uids, np.int64), doc_id=np.frombuffer(keys, np.int64), n=np.frombuffer(n, np.int64))
            elif kind == 1:
                of_pair = {c: np.frombuffer(x, np.int64) for c, x in (("doc_id", v), ("s", w)) if x}
                yield _sum_rows(1, uid=np.frombuffer(uids, np.int64), key=np.frombuffer(keys, np.int64), n=np.frombuffer(times, np.int32), **of_pair)
            else:
                own = _from_planes(keys)
                each = np.frombuffer(lens, np.uint32 if len(lens) == 4 * len(own) else np.uint16)
                grams.append((own, np.frombuffer(n, np.int32), np.frombuffer(hot, bool), *(np.frombuffer(x, np.int64) for x in (v, w)), each, np.frombuffer(owners, np.uint16), np.frombuffer(times, np.int32), np.frombuffer(uids, np.int64)))
    if not grams:
        return
    keys, n, hot = (np.concatenate([g[i] for g in grams]) for i in range(3))
    order = np.argsort(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
    totals = np.add.reduceat(n[order].astype(np.int64), new)
    warm = np.logical_or.reduceat(hot[order], new)
    if warm.any():
        yield _sum_rows(3, key=keys[order[new]][warm].view(np.int64), n=totals[warm])
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(totals, np.diff(np.append(new, len(keys))))
    value = micro(total)
    at = 0
    for own, _, _, v, w, lens, owners, times, uids in grams:
        upto = at + len(own)
        if len(uids):
            got = np.bincount(owners, np.repeat(value[at:upto], lens) * times, len(uids))  # whole numbers far below 2 ** 53
            yield _sum_rows(0, uid=uids, s=got)
            if len(v):
                lost = np.flatnonzero(np.repeat((total[at:upto] == 0) & ((v != 0) | (w != 0)), lens))
                if len(lost):
                    of = np.repeat(np.arange(len(own)), lens)[lost]
                    yield _sum_rows(4, uid=uids[owners[lost]], key=v[of], s=w[of], n=times[lost])
        at = upto


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(word_hashes(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["word", "n"])


def scored(docs: DataFrame, corpus: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """doc_id, n_words and score (natural log, summed) of each distinct doc_id and text of docs, by the n-grams of corpus (None: of docs itself).

    Word w after v: c(vw) / c(v) if the corpus has vw, else ALPHA * c(w) / N; the first word c(w) / N. A word that the corpus does not have
    counts as seen once. All words and pairs of all rows of the corpus count, at any number of occurrences. Null or blank text: 0 words, 0.
    doc_id is a whole number or null; rows with the same doc_id and text are one; other columns are not read. Words are told apart by
    64-bit hashes. An n-gram's occurrences meet in the part of its hash, where each lot of texts has sent one entry; the documents of one
    that is hot in a lot (of about held words) stay spread and are joined to its count by size-checked broadcast.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lambda df: df.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with arrow_rows(spark, BATCH):
        parcels = rows(docs).mapInArrow(_parcels(parts, corpus is None, True, held), PARCEL_TYPE)
        if corpus is not None:
            blank = corpus if "doc_id" in corpus.columns else corpus.withColumn("doc_id", F.lit(0))
            parcels = parcels.union(rows(blank).mapInArrow(_parcels(parts, True, False, held), PARCEL_TYPE))
    with arrow_rows(spark, 64):
        sums = stored(parcels.repartitionById(parts, F.col("part")).mapInArrow(_resolved, SUM_TYPE), "sums")
    if corpus is None:
        total = sums.filter("kind = 2").agg(F.sum("n")).first()[0] or 1
    else:
        words = stored(corpus.select(F.col("text").cast("string")).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
        total = words.agg(F.sum("c")).first()[0] or 1
    of_total = int(micro(np.array([total]))[0])
    value = lambda c: F.floor(SCALE * F.ln(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("double")) + 0.5)
    counts = stored(sums.filter("kind = 3").select(F.col("key").alias("_key"), F.col("n").alias("c")), "hot")
    start = F.when(F.col("n") > 0, F.lit(-of_total)).otherwise(0)
    zero = F.lit(0).cast("long")
    alls = sums.filter("kind = 2").select("uid", "doc_id", F.col("n").alias("words"), F.lit(1).cast("long").alias("copies"), start.cast("long").alias("s"))
    nothing = (F.lit(None).cast("long"), zero, zero)
    alls = alls.union(sums.filter("kind = 0").select("uid", *nothing, "s"))
    warm = sums.filter("kind = 1").join(small(counts), F.col("key") == F.col("_key"))
    alls = alls.union(warm.select("uid", *nothing, (F.col("n") * value(F.col("c"))).cast("long")))
    if corpus is not None:
        lost = sums.filter("kind = 4").select("uid", F.col("key").alias("v"), F.col("s").alias("w"), "n")
        lost = lost.union(warm.filter("c = 0 AND (doc_id <> 0 OR s <> 0)").select("uid", "doc_id", "s", "n"))
        for side in ("v", "w"):
            lost = lost.join(small(words).select(F.col("word").alias(f"_{side}"), F.col("c").alias(f"c{side}")), F.col(side) == F.col(f"_{side}"), "left")
        back = value(F.col("cv")) + value(F.col("cw")) + round(SCALE * float(np.log(ALPHA))) - of_total
        alls = alls.union(lost.select("uid", *nothing, (F.col("n") * back).cast("long")))
    found = alls.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("words").alias("words"), F.sum("copies").alias("copies"), F.sum("s").alias("s"))
    found = found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))
    return found.select("doc_id", F.expr("words div copies").alias("n_words"), F.round(F.col("s") / F.col("copies") / SCALE, 6).alias("score"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words and score of every document, by the words and pairs of words of all documents; see scored()."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(list_concat([NULL], ws[:-2])) AS prev FROM w),
uni AS (SELECT word, count(*) AS c FROM t GROUP BY word),
bi AS (SELECT prev, word, count(*) AS c FROM t WHERE prev IS NOT NULL GROUP BY prev, word),
s AS (SELECT t.doc_id, CAST(floor({SCALE} * ln(coalesce(bi.c, a.c)) + 0.5) AS BIGINT)
        - CAST(floor({SCALE} * ln(coalesce(b.c, (SELECT count(*) FROM t))) + 0.5) AS BIGINT) AS s
      FROM t JOIN uni a ON t.word = a.word LEFT JOIN uni b ON t.prev = b.word LEFT JOIN bi ON t.prev = bi.prev AND t.word = bi.word)
SELECT d.doc_id, CAST(count(s.s) AS BIGINT) AS n_words, round(CAST(coalesce(sum(s.s), 0) AS BIGINT) / {SCALE}, 6) AS score
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
