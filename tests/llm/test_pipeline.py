"""run() of the pipeline, row by row, against the five stages in plain Python."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tests.llm.conftest import prose
from tests.llm.test_operators import brute, ws
from tributary.llm import mixing, quality


#: The documents that are not spam.
TRUSTED = set(range(1, 76))


def lines_of(seed, n=4, width=30):
    w = prose(seed, n * width).split()
    return [" ".join(w[i : i + width]) for i in range(0, len(w), width)]


def fixture():
    rng, rows = random.Random(5), []
    for i in range(70):
        rows.append(["\n".join(lines_of(1000 + i, 3 + i % 4)), "en", "big" if i < 45 else "small" if i < 62 else None])
    for i in range(0, 70, 9):  # a line that many share, in another spelling of the blanks and with one sign changed
        rows[i][0] += "\n  All of this text is under a licence of its own, see the notice at the end" + ("." if i % 2 else "!")
    for i in (3, 20, 50):  # the same words on other lines: near copies without near lines
        w = rows[i][0].split()
        w[len(w) // 2] = "changed"
        rows.append(["\n".join([" ".join(w[:15]), *[" ".join(w[j : j + 30]) for j in range(15, len(w), 30)]]), "en", "small"])
    rows += [[rows[7][0], "en", "big"], [rows[50][0], "en", "big"]]  # exact copies: all their lines go
    spam = "cheap pills order now best price win prize click here free offer".split()
    rows += [[" ".join(rng.choice(spam) for _ in range(100)), "en", "big"] for _ in range(12)]
    rows += [["few words", "en", "small"], ["la la la " * 40, "en", "big"], [None, "en", "small"], ["", None, None], [" \n", "en", "big"]]
    return [(i + 1, t, lang, source, None if t is None else len(t)) for i, (t, lang, source) in enumerate(rows)]


def by_quality(rows, good):
    def buckets(text):
        t = re.findall(r"[^\W]+|[^\w\s]+", text or "")
        return [zlib.crc32(x.encode()) % 65536 for x in t + [f"{a} {b}" for a, b in itertools.pairwise(t)]]

    raw, target, out = Counter(), Counter(), []
    for r in rows:
        raw.update(buckets(r[1]))
        if r[0] in good:
            target.update(buckets(r[1]))
    nr, nt = sum(raw.values()) + 65536, sum(target.values()) + 65536
    for r in rows:
        w, b = ws(r[1]), buckets(r[1])
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)})
        if len(w) < 50 or 100 * again > 50 * len(w):
            continue
        mean = sum(math.log((target[x] + 1) / nt) - math.log((raw[x] + 1) / nr) for x in b) / len(b)
        assert abs(mean - quality.THRESHOLD) > 1e-3
        if mean > quality.THRESHOLD:
            out.append(r)
    return out


def by_lines(rows):
    trimmed = {x.strip(" \t\n\v\f\r") for r in rows for x in r[1].split("\n")} - {""}
    sets = {x: {x[i : i + 5] for i in range(len(x) - 4)} for x in trimmed}
    root = {x: x for x in trimmed}
    for x, y in itertools.combinations(sorted(trimmed), 2):
        if root[x] != root[y] and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            old, new = root[y], root[x]
            root = {k: new if v == old else v for k, v in root.items()}
    seen, out = set(), []
    for d, text, lang, source, n in rows:
        kept = []
        for line in text.split("\n"):
            key = root.get(line.strip(" \t\n\v\f\r"))
            if key is None or key not in seen:
                kept.append(line)
            seen.add(key)
        new = "\n".join(kept)
        if len(kept) == len(text.split("\n")):
            out.append((d, text, lang, source, n))
        elif new.strip():
            out.append((d, new, lang, source, len(new)))
    return out


def chained(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
    return h


def mixed(rows):
    tokens, held = Counter(), defaultdict(list)
    for r in rows:
        tokens[r[3]] += len(ws(r[1]))
        held[r[3]].append(r)
    sizes = list(tokens.values())
    entropy = lambda a: -math.fsum(p * math.log(p) for p in ([t**a / math.fsum(u**a for u in sizes) for t in sizes]))
    goal, most, least = (entropy(1) + math.log(len(sizes))) / 2, max(sizes), min(sizes)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= goal else (low, mid)
    a = max(low, 1 - math.log(mixing.MAX_REPEAT) / math.log(most / least) if most > mixing.MAX_REPEAT * least else 0)
    out = []
    for source, own in held.items():
        quota = math.floor(most**(1 - a) * tokens[source] ** a + 1e-6)
        passes, left = divmod(quota, tokens[source])
        out += own * passes
        for r in sorted(own, key=lambda r: chained(mixing.SEED.to_bytes(4, "little"), r[3], r[0].to_bytes(8, "little"), r[1])):
            left -= len(ws(r[1]))
            if left < 0:
                break
            out.append(r)
    return out


def encoded(rows):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        ids = theirs.encode_ordinary(r[1])
        yield r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in sorted(TRUSTED)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_matches_brute_force(spark, folder):
    import corpus_pipeline

    rows = fixture()
    good = by_quality(rows, TRUSTED)
    assert {r[0] for r in rows} - {r[0] for r in good} == set(range(76, 93))
    lined = by_lines(good)
    assert {r[0] for r in good} - {r[0] for r in lined} == {74, 75} and sum(x[1] != y[1] for x in good for y in lined if x[0] == y[0]) >= 7
    roots = brute([r[:2] for r in lined])
    near = [r for r in lined if roots[r[0]] == r[0]]
    assert {r[0] for r in lined} - {r[0] for r in near} == {71, 72, 73}
    want = mixed(near)
    assert len(want) > len(near) and {r[0] for r in want} == {r[0] for r in near}
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got) == sorted(encoded(want))


def test_run_of_empty_tables_extra_columns_and_repeated_rows(spark, folder, tmp_path):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for name, rows in (("none", docs.limit(0)), ("more", docs.union(docs.filter("doc_id IN (1, 60)")).selectExpr("*", "'x' AS kept", "1 AS copies", "doc_id AS root", "lang AS hash"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    want = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/more").collect()} == want
