"""Operator 12, benchmark decontamination: word windows of the benchmark found in documents, words and all, and spans or documents removed.

A table of marks, of a fixed size whatever the benchmark's, says by a window's hash whether it may be one of the benchmark; workers try it at every place
of a text. Only windows that pass are spelled out and meet the benchmark's in a hash join on all their words, which
verifies them: broadcast, or shuffled beyond the size limit. Texts themselves are never shuffled. Windows have ten words, or all words of an item that has
fewer; so there are ten lengths at most. Everything is built-in functions; a document's own places are the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import drop_stored, let, lower_ascii, small, stored, table

GRAM = 10
#: Marks of hashes. With more windows than that nearly every place passes and the join alone decides.
SLOTS = 1 << 17
#: What stands between words of lower-cased text, and of text as it is.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Capital letters outside ASCII: where there are none, lower() changes A-Z alone and is much the faster.
FOREIGN_CAPITAL = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
KEY = ("k1", "k2")


def bare_words(text: Column) -> Column:
    """The words of text: runs of 0-9, a-z after A-Z are lowered, and characters beyond ASCII. Null has none."""
    low = F.when(text.rlike(FOREIGN_CAPITAL), lower_ascii(text)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(low, GAP + "+"), ""), F.array().cast("array<string>"))


class Benchmark:
    """The windows of a benchmark's items as stored tables: grams (g, n, slot, gram) and owners (g, item); and marks, a byte for each slot.

    Null and wordless texts give no window. Equal windows of many items are one gram. An item without id has windows that mark
    words, but is not listed. An empty benchmark has no windows.
    """

    def __init__(self, items: DataFrame, item: str = "item_id", text: str = "text"):
        words = items.select(F.col(f"`{item}`").cast("string").alias("item"), bare_words(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (GRAM - 1), F.lit(1)))
        grams = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, GRAM))).alias("w"))
        every = stored(grams.select("item", F.array_join("w", " ").alias("gram"), F.size("w").alias("n"), _slot(F.col("w")).alias("slot")), "windows")
        self.grams = stored(every.select("gram", "n", "slot").distinct().withColumn("g", F.monotonically_increasing_id()), "grams")
        self.owners = stored(every.filter("item IS NOT NULL").join(small(self.grams), ["gram", "n", "slot"]).select("g", "item").distinct(), "owners")
        self.sizes = sorted(r.n for r in self.grams.select("n").distinct().collect())  # GRAM numbers at most
        marks = bytearray(SLOTS)
        for r in self.grams.select("slot").distinct().collect():  # SLOTS numbers at most
            marks[r.slot] = 1
        self.marks = bytes(marks)
        drop_stored(every)

    def drop(self) -> None:
        drop_stored(self.grams, self.owners)


def _slot(window: Column) -> Column:
    return F.pmod(F.xxhash64(window), F.lit(SLOTS)).cast("int")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs, its columns packed into `row`, with its text as `body` and two hashes of it: equal texts share them, and the result."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(whole.alias("row"), F.col(f"`{text}`").alias("body"))
    return packed.withColumns({k: F.xxhash64(F.lit(i), "body") for i, k in enumerate(KEY)})


def hits(docs: DataFrame, bench: Benchmark, text: str = "text") -> DataFrame:
    """k1, k2 (hashes of a text), n_hit (words inside windows), spots (at, n, g: the verified places, in order) of each text that has some; a stored table.

    Equal texts are one row here, whatever their number.
    """
    rows = _keyed(docs, text).select(*KEY, "body")
    marks = F.lit(bench.marks)
    none = F.array().cast("array<struct<at:int,n:int,gram:string>>")

    def places(w: Column, n: int) -> Column:
        here = F.filter(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.substring(marks, _slot(F.slice(w, i, n)) + 1, F.lit(1)) == F.lit(b"\x01"))
        return F.when(F.size(w) >= n, F.transform(here, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(w, i, n), " ").alias("gram")))).otherwise(none)

    every = let(bare_words(F.col("body")), lambda w: F.concat(none, *[places(w, n) for n in bench.sizes]))
    met = rows.select(*KEY, F.inline(every)).join(_sized(bench.grams, "gram", "n", "g"), ["gram", "n"]).select(*KEY, "at", "n", "g").distinct()
    found = met.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("at", "n", "g"))).alias("spots"))
    # places are sorted: each adds its words beyond the furthest end so far
    last = lambda s: s["at"] + s["n"] - 1
    covered = F.aggregate(
        "spots",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], last(s)).alias("end"), (a["n"] + F.greatest(F.lit(0), last(s) - F.greatest(a["end"], s["at"] - 1))).alias("n")),
        lambda a: a["n"],
    )
    return stored(found.select(*KEY, covered.alias("n_hit"), "spots"), "hits")


def _sized(df: DataFrame, *columns) -> DataFrame:
    """Columns of a stored table, broadcast if the whole table may be."""
    out = df.select(*columns)
    out._bytes = df._bytes
    return small(out)


def items_of(found: DataFrame, bench: Benchmark) -> DataFrame:
    """k1, k2, n_items and items (ids as strings, sorted, comma-joined) of each text with hits."""
    own = found.select(*KEY, F.explode(F.array_distinct(F.transform("spots", lambda s: s["g"]))).alias("g")).join(small(bench.owners), "g")
    items = own.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return items.select(*KEY, F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def report(docs: DataFrame, bench: Benchmark, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with n_words, n_hit, n_items, items and contaminated, a row for each row; names that docs has already are replaced."""
    found = hits(docs, bench, text)
    sums = stored(found.select(*KEY, "n_hit").join(items_of(found, bench), list(KEY), "left"), "sums")
    drop_stored(found)
    whole = F.struct(*[F.col("row").getField(c).alias(c) for c in (docs.columns if keep is None else keep)]).alias("row")
    out = _keyed(docs, text).select(whole, *KEY, F.size(bare_words(F.col("body"))).cast("long").alias("words")).join(small(sums), list(KEY), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    more = {"n_words": F.col("words"), "n_hit": zero(F.col("n_hit")), "n_items": zero(F.col("n_items")), "items": F.coalesce("items", F.lit("")), "contaminated": zero(F.col("n_hit")) > 0}
    kept = [F.col("row").getField(c).alias(c) for c in (docs.columns if keep is None else keep) if c.lower() not in more]
    return out.select(*kept, *[c.alias(k) for k, c in more.items()])


def cleaned(docs: DataFrame, bench: Benchmark, remove: str = "spans", text: str = "text") -> DataFrame:
    """docs without what the benchmark has: `spans` cuts each hit word with the gap before it out of the text, `documents` drops every row with a hit.

    Null texts stay null; texts without hits stay as they are.
    """
    found = hits(docs, bench, text)
    rows = _keyed(docs, text)
    if remove == "documents":
        return rows.join(_sized(found, *KEY), list(KEY), "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    pieces = F.regexp_extract_all("body", F.lit(f"(?s){RAW_GAP}*{RAW_WORD}+"), 0)
    hit = lambda i: F.exists("spots", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["n"]))
    left = F.concat(F.array_join(F.filter(pieces, lambda p, i: ~hit(i)), ""), F.regexp_extract("body", f"(?s){RAW_GAP}*\\z", 0))
    out = rows.join(small(found), list(KEY), "left").withColumn("left", F.when(F.col("spots").isNull(), F.col("body")).otherwise(left))
    return out.select(*[F.col("left").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` against all of `benchmark`, with the columns of the contract. No rows: none; an empty benchmark contaminates nothing."""
    bench = Benchmark(table(spark, sf_dir, "benchmark"))
    out = report(table(spark, sf_dir, "documents"), bench, keep=["doc_id"])
    bench.drop()
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
own AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS gram, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT DISTINCT gram, n FROM own),
places AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM grams))),
hit AS (SELECT r, n, i, gram FROM places JOIN grams USING (gram, n)),
words AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN own USING (gram, n) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
