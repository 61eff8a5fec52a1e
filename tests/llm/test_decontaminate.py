import hashlib
import random
import re

import duckdb
import pytest

from tests.llm.conftest import prose
from tributary.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words string, k1 int, row string"


def bare(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """(n_words, n_hit, ids) of each text by trying every window at every place."""
    grams = {}
    for item, text in items:
        w = bare(text)
        for i in range(max(len(w) - 9, 1 if w else 0)):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for text in docs:
        w, hit, ids = bare(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= own
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


def fixture(spark):
    a, b, c = prose(1, 40), prose(2, 14), "Émile ÉCOLE öde"
    bench = [(7, a), (7, a), (12, b), (100, b), (9, "only three Words"), (3, None), (4, "... --- !"), (None, prose(3, 11)), (5, c), (6, "ten words " * 5)]
    rng = random.Random(5)
    long = prose(6, 30_000).split()
    long[20_000:20_000] = a.split()[3:30]
    texts = [
        a, a.upper().replace(" ", "\n--"), " ".join(a.split()[:9]), " ".join(a.split()[5:15]), f"{prose(4, 60)} {b}, {b}", None, "", "?!", "x Only; THREE words y", "only three wordsé",
        prose(3, 11), "émile École öde", "Émile ÉCOLE öde", "ten words " * 40, " ".join(long), "ten words ten", *[" ".join(rng.choices(a.split(), k=200)) for _ in range(5)],
    ]
    rows = [(i, t, "own", 1, None) for i, t in enumerate(texts)] + [(0, a, "own", 1, None), (0, b, None, None, None), (None, a, "own", 1, "z"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, rows, spark.createDataFrame(bench, "item_id long, text string"), bench


def test_report_matches_brute_force(spark):
    docs, rows, items, bench = fixture(spark)
    got = decontaminate.report(docs, decontaminate.Benchmark(items))
    want = sorted((str(r[0]), str(r[1]), n, hit, len(ids), ",".join(ids), hit > 0) for r, (n, hit, ids) in zip(rows, plain([r[1] for r in rows], bench)))
    assert sorted((str(r.doc_id), str(r.text), r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in got.collect()) == want


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, _, items, _ = fixture(spark)
    want = sorted(map(str, decontaminate.report(docs, decontaminate.Benchmark(items)).collect()))
    monkeypatch.setattr(decontaminate, "small", lambda df: df.hint("merge"))
    assert sorted(map(str, decontaminate.report(docs, decontaminate.Benchmark(items)).collect())) == want


def test_cleaned(spark):
    docs, rows, items, bench = fixture(spark)
    bm = decontaminate.Benchmark(items)
    hit = [n for _, n, _ in plain([r[1] for r in rows], bench)]
    kept = decontaminate.cleaned(docs, bm, "documents")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not plain([r.text], bench)[0][1])
    cut = decontaminate.cleaned(docs, bm)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    by = {(r.doc_id, r.row): r.text for r in cut.filter("doc_id > 0").collect()}
    assert by[5, None] is None and by[6, None] == "" and by[7, None] == "?!" and by[8, None] == "x y" and by[9, None] == "only three wordsé"
    assert by[4, None] == prose(4, 60) and by[15, None] == "ten words ten"
    assert len(bare(by[14, None])) == 30_027 - hit[14] and sum(hit) > 0
    with pytest.raises(ValueError):
        decontaminate.cleaned(docs, bm, "lines")


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, empty):
    docs, rows, items, _ = fixture(spark)
    docs = docs.limit(0) if empty != "items" else docs
    items = items.limit(0) if empty != "docs" else items
    got = decontaminate.report(docs, decontaminate.Benchmark(items)).collect()
    assert len(got) == (len(rows) if empty == "items" else 0) and not any(r.n_hit or r["items"] or r.contaminated for r in got)


def test_query_equals_its_sql_and_brute_force(spark):
    at = "/root/testdata/sf0.001"
    got = sorted(map(tuple, decontaminate.op12_decontamination(spark, at).collect()))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    assert got == sorted(db.execute(decontaminate.ORACLE).fetchall())
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    want = [(d.doc_id, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0) for d, (n, hit, ids) in zip(docs, plain([d.text for d in docs], items))]
    assert got == sorted(want) and any(r[-1] for r in got)
