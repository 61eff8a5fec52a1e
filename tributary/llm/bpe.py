"""Operator 10, byte-level BPE: ranks compiled into a lazily determinised transducer; streaming decode.

The automaton's state is the bytes read since the last token boundary that is certain. Let u be those bytes. A token
that reaches beyond u can begin only where a suffix of u begins some vocabulary entry; before each such place the
tokens are those of that prefix of u alone, since any run of tokens of a BPE encoding is the encoding of its own
bytes. So the tokens that all these prefixes have in common are certain: they are emitted, their bytes leave the
state. The lookahead is thus less than the longest entry. States and arcs are made when a text first needs them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import table

#: Arcs and encoded pieces that one worker remembers; beyond it begins anew. It bounds memory, not results.
MOST_ARCS = 400_000
MOST_PIECES = 250_000


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of piece by repeated merging of the pair with the lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Reads the bytes of a piece and emits token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.begins = {token[:i] for token in ranks for i in range(1, len(token))}
        # entries that merging does not reach; where there are none, the transducer needs no test for whole pieces
        self.unreached = frozenset(t for t in ranks if len(t) > 1 and merged(t, ranks) != [t])
        self.reset()

    def reset(self) -> None:
        self.arcs: dict[tuple[bytes, int], tuple[bytes, tuple[int, ...]]] = {}
        self.ends: dict[bytes, tuple[int, ...]] = {}

    def arc(self, state: bytes, byte: int) -> tuple[bytes, tuple[int, ...]]:
        u = state + bytes([byte])
        open_at = [i for i in range(len(u)) if u[i:] in self.begins] + [len(u)]
        certain = merged(u[: open_at[0]], self.ranks)
        for i in open_at[1:]:
            other = merged(u[:i], self.ranks)
            n = 0
            while n < min(len(certain), len(other)) and certain[n] == other[n]:
                n += 1
            certain = certain[:n]
            if not certain:
                break
        return u[sum(map(len, certain)) :], tuple(self.ranks[t] for t in certain)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece; a piece that is itself an entry is that entry, as in the ranks' own library."""
        if piece in self.unreached:
            return (self.ranks[piece],)
        if len(self.arcs) > MOST_ARCS:
            self.reset()
        state, out, arcs = b"", [], self.arcs
        for byte in piece:
            got = arcs.get((state, byte))
            if got is None:
                got = arcs[state, byte] = self.arc(state, byte)
            state, tokens = got
            if tokens:
                out += tokens
        if state:
            rest = self.ends.get(state)
            if rest is None:
                rest = self.ends[state] = tuple(self.ranks[t] for t in merged(state, self.ranks))
            out += rest
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8: feed() returns the characters completed so far, its state is the 0 to 3 bytes of an open one.

    Ill-formed bytes become U+FFFD as in bytes.decode("utf-8", "replace"); finish() ends the stream.
    """

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            needs = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if needs > back and self._may_follow(data[-back:]):
                keep = back
            break
        self.open = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _may_follow(head: bytes) -> bool:
        """Whether the second byte, if there, is one that its lead byte allows."""
        if len(head) < 2:
            return True
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(head[0], 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(head[0], 0xBF)
        return low <= head[1] <= high

    def finish(self) -> str:
        rest, self.open = self.open.decode("utf-8", "replace"), b""
        return rest


class ByteBpe:
    """Encoder and decoder over a file of ranks (base64 of the token, blank, rank) and the pattern that cuts texts into pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.fst = Transducer(self.ranks)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        if len(pieces) > MOST_PIECES:
            pieces.clear()
        for piece in self.find(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.fst.encode(piece.encode("utf-8"))
                if len(piece) < 64 and len(pieces) <= MOST_PIECES:
                    pieces[piece] = ids
            out += ids
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], every: int = 256) -> Iterator[str]:
        """Text as the ids come, never cut inside a character."""
        machine, waiting = Utf8Machine(), []
        for i in ids:
            waiting.append(self.tokens[i])
            if len(waiting) == every:
                if text := machine.feed(b"".join(waiting)):
                    yield text
                waiting.clear()
        if text := machine.feed(b"".join(waiting)) + machine.finish():
            yield text


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """One per worker process; by default the public 50k vocabulary, found where this machine has it."""
    import public_tokenizers

    return ByteBpe(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encoded(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null text counts as empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for part in bpe.decode_stream(ids, 4096):
                    digest.update(part.encode("utf-8"))
                text_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)
