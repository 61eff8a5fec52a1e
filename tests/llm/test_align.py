import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tributary.llm import align


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelled(sides, text):
    """[(id, bytes)] of either side, one whole text at a time."""
    a, b = sides
    letters = align.byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def plain(sides, texts):
    """The contract's columns by comparing every token of one side with every one of the other."""
    counts, docs = Counter(), []
    for text in texts:
        left, right = spelled(sides, text) if text else ([], [])
        if not text or not b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode():
            docs.append(None)
            continue
        spans = []
        for side in (left, right):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = []
        for s, e, i in spans[0]:
            links += [(i, j) for s2, e2, j in spans[1] if s < e2 and s2 < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if begin <= s and e <= cut) for own in spans))
            begin = cut
        counts.update(links)
        docs.append((len(left), len(right), groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else
        (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
        for d in docs
    ]


TEXTS = [
    None, "", " ", "\n", "a", "naïve café — Größe", "x" * 300, "tab\there", "two  blanks \n\n and lines\n", "<|endoftext|> <0x41> <s> </s>", "nbsp here", "wide　blank", "piece▁mark",
    "日本語のテキスト 🙂🙂", "don't we'll I'm", "\x00 nul", "ﬁ ligature ²", " begins with a blank", "ends with blanks   ", "\r\nwindows\r\n", "é combined", "\n\n  \n x \n", "1234567890 12 3",
]


def rows_of(got):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got]


def test_odd_texts_match_brute_force(spark, sides):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab \n.,é▁\t'0ſ中🙂") for _ in range(rng.randint(1, 40))) for _ in range(150)] + [prose(3, 300)] * 2
    docs = spark.createDataFrame([(i, t, None, i) for i, t in enumerate(texts)], "doc_id long, text string, row string, b int")
    got = align.aligned(docs).orderBy("doc_id").collect()
    assert rows_of(got) == plain(sides, texts)


def test_small_lots_and_flushes_change_nothing(spark, sides, monkeypatch):
    texts = [prose(i, 60) for i in range(40)] + ["the " * 500, "the", "the end"] * 5
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = sorted(rows_of(align.aligned(docs).collect()))
    assert want == sorted(plain(sides, texts))
    monkeypatch.setattr(align, "LOT", 3)
    monkeypatch.setattr(align, "TIMES", 1)
    monkeypatch.setattr(align, "small", lambda df: df)
    assert sorted(rows_of(align.aligned(docs).collect())) == want


def test_flushes_within_a_worker(sides):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    row, codes = np.sort(rng.integers(0, 50, 4000)), rng.integers(0, 9 * 32000, 4000)
    n = rng.integers(1, 5, 4000).astype(np.int64)
    posts, counts = (pa.Table.from_batches([x]).to_pylist() for x in align._segments(row, codes, n, 32000))
    want, sums = Counter(), Counter()
    for r, c, k in zip(row.tolist(), codes.tolist(), n.tolist()):
        want[c % 32000, c // 32000, r] += k
        sums[c % 32000, c // 32000] += k
    got = Counter()
    for x in posts:
        for a, r, k in zip(x["a"], x["rows"], x["n"]):
            got[x["b"], a, r] += k
    assert got == want and {(x["b"], a): k for x in counts for a, k in zip(x["a"], x["n"])} == sums
    assert all(x["size"] == len(x["a"]) for x in posts + counts)


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "abc"), (None, None), (5, "abc")], "doc_id long, text string")
    assert align.aligned(docs.limit(0)).count() == 0
    got = align.aligned(docs).collect()
    assert sum(r.doc_id is None for r in got) == 2 and sorted(r.n_links > 0 for r in got) == [False, True, True]


def test_query_matches_brute_force(spark, sides):
    at = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").collect())
    whole = align.op11_tokenizer_alignment(spark, at)
    assert whole.count() == spark.read.parquet(f"{at}/documents.parquet").count()
    some = spark.createDataFrame(docs, "doc_id long, text string")
    got = align.aligned(some).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [d for d, _ in docs] and rows_of(got) == plain(sides, [t for _, t in docs])
