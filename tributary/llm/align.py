"""Operator 11, cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often each pair does so in the corpus.

Workers tokenise whole texts and keep, of each document, how often it links each pair of ids: its postings. Postings are shuffled by the
id of side B, a hot id in as many lots as it needs, every lot with the id's counts, which were summed over each flush of a worker;
rows are sorted by id with the counts first, so that a task streams through them: it sums an id's counts, takes their maximum,
and turns the postings that follow into contributions to documents, which are summed by document. Postings of one id and one flush
travel as one row of arrays. Memory of a task: one flush, or one id's counts, which are no more than side A has entries.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow_rows, small, stored, table

#: Links that a worker gathers before it writes their postings; chunks that it remembers; texts sent to it at once. They bound memory, not results.
FLUSH = 1_000_000
MOST_CHUNKS = 300_000
ROWS = 500
#: Postings of one lot of a hot id, at least; and how many times as many as its counts, which go to every lot.
LOT, TIMES = 20_000, 8
#: What lots add to documents goes to buckets of so many documents, by the first bits of their numbers.
BUCKET_BITS = 12
GIVEN = "bucket long, rows array<long>, n_best array<long>, count_sum array<long>"

#: Where two chunks of a text may be cut: before a blank or line feed that follows anything else. Texts with other white space are one chunk.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
OTHER_SPACE = re.compile(r"[^\S \n]")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with their tokens' bytes. Encodes chunk by chunk where that is sure to give what the whole text gives."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size, self.blank = n, self.b.piece_to_id("▁")
        self.a_length, self.b_length = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), n))))
        #: no entry of B goes on after a blank that follows something else, so B never merges across the places where CHUNK cuts
        self.cuts = not any(re.search("[^▁][▁\n]|\n.", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        with open(a_path) as file:
            self.fast = self._ranks(json.load(file))
        self.cuts = self.cuts and self.fast is not None
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _ranks(self, spec: dict):
        """Side A as ranks, which encode a few times faster; None where its file says more than merges over the public pattern.

        Such ranks are the order of merges, so both encode any piece alike if each entry merges to itself.
        """
        import public_tokenizers
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE"
        if not plain or model.get("ignore_merges") or model.get("dropout"):
            return None
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
        added = {x["id"] for x in spec["added_tokens"]}
        if ranks != {t: i for i, t in enumerate(self.a_bytes) if i not in added}:
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of each text, which begins with a blank, and B's, which adds that blank itself."""
        a = [self.fast.encode_ordinary(t) for t in texts] if self.fast else [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[bytes, str, bytes] | None:
        """n_a, n_b and n_groups, packed; the groups; the pair (a * b_size + b) of each link, packed. None if either side's bytes differ from the text's.

        Both sides are walked together: the stretch up to the nearer of the two ends belongs to one token of either, and no two stretches to the same two.
        """
        if not self._same(text, a, b):
            return None
        length_a, length_b, name, size = self.a_length, self.b_length, self.names, self.b_size
        pairs, groups = array("q"), []
        i = j = from_a = from_b = 0
        end_a, end_b = length_a[a[0]], length_b[b[0]]
        while True:
            pairs.append(a[i] * size + b[j])
            if end_a < end_b:
                i += 1
                end_a += length_a[a[i]]
            elif end_b < end_a:
                j += 1
                end_b += length_b[b[j]]
            else:
                i, j = i + 1, j + 1
                left = name[a[from_a]] if i - from_a == 1 else ",".join([name[x] for x in a[from_a:i]])
                groups.append(f"{left}|{name[b[from_b]]}" if j - from_b == 1 else left + "|" + ",".join([name[x] for x in b[from_b:j]]))
                if i == len(a):
                    return array("q", (len(a), len(b), len(groups))).tobytes(), ";".join(groups), pairs.tobytes()
                from_a, from_b = i, j
                end_a += length_a[a[i]]
                end_b += length_b[b[j]]

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        want, bytes_a, bytes_b = text.encode(), self.a_bytes, self.b_bytes
        return b"".join([bytes_b[i] for i in b]) == want and b"".join([bytes_a[i] for i in a]) == want

    def records(self, texts: list[str]) -> list[list[tuple] | None]:
        """Of each text, which begins with a blank, its chunks' records; None where it has no tokens.

        Chunks are remembered for two generations: one that is met again moves to the younger, and the elder goes when the younger is full.
        """
        if len(self.young) > MOST_CHUNKS // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        cut: list[list[str] | None] = [CHUNK.findall(t) if self.cuts and not OTHER_SPACE.search(t) else None for t in texts]
        new = []
        for chunk in {c for own in cut if own for c in own}.difference(young):
            if chunk in old:
                young[chunk] = old[chunk]
            else:
                new.append(chunk)
        for chunk, a, b in zip(new, *self._chunk_ids(new)):
            young[chunk] = self.aligned(chunk, a, b)
        got: list[list[tuple] | None] = []
        for text, own in zip(texts, cut):
            found = [young[c] for c in own] if own else None
            if found is None or None in found:  # the whole text decides
                (a,), (b,) = self.ids([text])
                whole = self.aligned(text, a, b)
                found = None if whole is None else [whole]
            got.append(found)
        return got

    def _chunk_ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """B adds a blank before any text; a chunk that begins with a line feed is encoded after one more blank, which goes again."""
        a = [self.fast.encode_ordinary(t) for t in chunks] if self.fast else [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in chunks], num_threads=1)
        for i, t in enumerate(chunks):
            if t[0] != " ":
                b[i] = b[i][1:] if b[i][:1] == [self.blank] else [-1]
        return a, [x if -1 not in x else [] for x in b]


@lru_cache(maxsize=1)
def pair(a_path: str | None = None, b_path: str | None = None) -> Pair:
    """One per worker process; by default the public files, found where this machine has them."""
    import public_tokenizers

    return Pair(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))


TOKENISED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, size long, a array<int>, rows array<long>, n array<int>"
_TYPES = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
_NAMES = [f.split()[0] for f in TOKENISED.split(", ")]


def _table(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def _lists(values: np.ndarray, starts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _segments(row: np.ndarray, codes: np.ndarray, n: np.ndarray, b_size: int) -> Iterator[pa.RecordBatch]:
    """Rows of postings (b, a, rows, n) and of counts (b, a, n) from one flush's postings."""
    key = (codes % b_size << 32) + codes // b_size
    order = np.argsort(key, kind="stable")  # rows come in order
    key, row, n = key[order], row[order], n[order]
    a, b = key & ((1 << 32) - 1), key >> 32
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    size = np.diff(np.append(starts, len(b)))
    yield _table(len(starts), b=pa.array(b[starts], pa.int32()), size=pa.array(size, pa.int64()), a=_lists(a, starts, pa.int32()), rows=_lists(row, starts, pa.int64()), n=_lists(n, starts, pa.int32()))
    key, total = _summed(key, n)
    b, a = key >> 32, key & ((1 << 32) - 1)
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    size = np.diff(np.append(starts, len(b)))
    yield _table(len(starts), b=pa.array(b[starts], pa.int32()), size=pa.array(size, pa.int64()), a=_lists(a, starts, pa.int32()), n=_lists(total, starts, pa.int32()))


def tokenised(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows of three kinds: documents (row, doc_id, sums, digest), postings (b, a, rows, n) and counts (b, a, n without rows) of each flush.

    Null and empty texts, and those whose tokens' bytes are not the text's, have zeros and an empty digest. row numbers the rows, so
    repeated ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                row, codes, n = (np.concatenate(x) for x in zip(*waiting))
                yield from _segments(row, codes, n, both.b_size)
            waiting.clear()
            held = 0

        for batch in batches:
            rows, texts = batch.column(0).to_numpy(), [t or "" for t in batch.column(2).to_pylist()]
            some = [i for i, t in enumerate(texts) if t]
            sums = np.zeros((4, len(texts)), np.int64)
            shas = [""] * len(texts)
            for i, own in zip(some, both.records([" " + texts[i] for i in some])):
                if own is None:
                    continue
                digest = hashlib.sha256()
                digest.update(";".join([r[1] for r in own]).encode())
                shas[i] = digest.hexdigest()
                codes = np.frombuffer(b"".join([r[2] for r in own]), np.int64)
                sums[:3, i] = np.frombuffer(b"".join([r[0] for r in own]), np.int64).reshape(-1, 3).sum(axis=0)
                sums[3, i] = len(codes)
                key, n = np.unique(codes, return_counts=True)
                waiting.append((np.full(len(key), rows[i]), key, n))
                held += len(key)
                if held >= FLUSH:
                    yield from flush()
            yield _table(
                len(texts), row=batch.column(0), doc_id=batch.column(1),
                **{c: pa.array(s, pa.int64()) for c, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums)}, groups_sha256=pa.array(shas, pa.string()),
            )
        yield from flush()

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENISED)


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What postings add to documents, from rows sorted by (b, lot, counts before postings): GIVEN, a row for each bucket of documents and flush."""
    at, counted, counts, best = None, [], None, 0
    rows: list[np.ndarray] = []
    n_best: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal held
        keys = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        add = lambda parts: np.add.reduceat(np.concatenate(parts)[order], starts) if len(starts) else np.zeros(0, np.int64)
        keys, best_of, sums_of = keys[starts], add(n_best), add(sums)
        buckets = keys >> BUCKET_BITS
        cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(buckets)])
        lists = [_lists(x, cuts, pa.int64()) for x in (keys, best_of, sums_of)]
        out = pa.RecordBatch.from_arrays([pa.array(buckets[cuts], pa.int64()), *lists], ["bucket", "rows", "n_best", "count_sum"])
        for part in (rows, n_best, sums):
            part.clear()
        held = 0
        return out

    for batch in batches:
        ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        a, of, n = batch.column(2), batch.column(3), batch.column(4)
        offsets, a_all, n_all = a.offsets.to_numpy(), a.values.to_numpy(), n.values.to_numpy()
        n_at, of_at, of_all = n.offsets.to_numpy(), of.offsets.to_numpy(), of.values.to_numpy()
        kind = of.is_null().to_pylist()
        for i, key in enumerate(ids):
            if key != at:
                at, counted, counts = key, [], None
            own, times = a_all[offsets[i] : offsets[i + 1]].astype(np.int64), n_all[n_at[i] : n_at[i + 1]].astype(np.int64)
            if kind[i]:
                counted.append((own, times))
                if len(counted) > 64:
                    counted = [_summed(*(np.concatenate(x) for x in zip(*counted)))]
                continue
            if counts is None:
                of_a, sums_a = _summed(*(np.concatenate(x) for x in zip(*counted)))
                counts, best = (of_a, sums_a), sums_a.max()
            found = counts[1][np.searchsorted(counts[0], own)]
            rows.append(of_all[of_at[i] : of_at[i + 1]])
            n_best.append(np.where(found == best, times, 0))
            sums.append(times * found)
            held += len(own)
            if held >= 2 * FLUSH:
                yield flush()
    yield flush()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, n_best, count_sum from GIVEN sorted by bucket: the sums of one bucket's documents at a time."""
    size, at = 1 << BUCKET_BITS, None
    sums, there = np.zeros((2, size), np.int64), np.zeros(size, bool)

    def done() -> pa.RecordBatch:
        own = np.flatnonzero(there)
        out = [own + (at << BUCKET_BITS), *sums[:, own]] if at is not None else [own, *sums[:, own]]
        sums[:], there[:] = 0, False
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "n_best", "count_sum"])

    for batch in batches:
        offsets = batch.column(1).offsets.to_numpy()
        rows, best, count = (batch.column(i).values.to_numpy() for i in (1, 2, 3))
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != at:
                yield done()
                at = bucket
            here = slice(offsets[i], offsets[i + 1])
            spots = rows[here] & (size - 1)  # each row once in a list
            sums[0, spots] += best[here]
            sums[1, spots] += count[here]
            there[spots] = True
    yield done()


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row, repeated ones included; other columns are not read."""
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS):
        every = stored(tokenised(docs, a_path, b_path), "tokenised")
    of_b = every.filter("b IS NOT NULL")
    # one row an id of B, so bounded by its vocabulary
    lots = of_b.groupBy("b").agg(F.sum(F.when(F.col("rows").isNotNull(), F.col("size")).otherwise(0)).alias("postings"), F.sum(F.when(F.col("rows").isNull(), F.col("size")).otherwise(0)).alias("counts"))
    lots = lots.select("b", F.ceil(F.col("postings") / F.greatest(F.lit(LOT), F.lit(TIMES) * F.col("counts"))).alias("lots"))
    spread = of_b.join(F.broadcast(lots), "b")
    every_lot = F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)
    one_lot = F.array(F.pmod(F.xxhash64(F.element_at("rows", 1), F.size("rows")), F.col("lots")))
    dealt = spread.select("b", F.explode(F.when(F.col("rows").isNull(), every_lot).otherwise(one_lot)).alias("lot"), "a", "rows", "n")
    dealt = dealt.repartition("b", "lot").sortWithinPartitions("b", "lot", F.col("rows").isNotNull())
    with arrow_rows(spark, ROWS):
        given = dealt.mapInArrow(_contributions, GIVEN).repartition("bucket").sortWithinPartitions("bucket")
        given = stored(given.mapInArrow(_totals, "row long, n_best long, count_sum long"), "given")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = every.filter("row IS NOT NULL").join(small(given), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents`, with the contract's columns. An empty table gives no rows."""
    return aligned(table(spark, sf_dir, "documents"))
