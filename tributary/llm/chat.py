"""Operator 3, chat formatting: the longest common turn prefix as prompt, the rest of either side as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import let, table

#: The role whose text the loss counts.
LEARNED = "assistant"


def turn_text(turn: Column) -> Column:
    """One turn as it is rendered."""
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns the two arrays have in common from their start."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False).cast("int")
    return F.when(n == 0, F.lit(0)).when(first == 0, n).otherwise(first - 1)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, turn_text), "")


def mask(turns: Column) -> Column:
    """Spans [start, end) in code points of rendered(turns) that the loss counts: texts of the learned role with the \\n that ends them."""
    ends = F.aggregate(
        turns,
        F.array(F.lit(0)),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(turn_text(t)))),
    )

    def spans(at: Column) -> Column:
        every = F.transform(
            turns,
            lambda t, i: F.when(
                t["role"] == LEARNED,
                F.struct((F.get(at, i) + F.length(t["role"]) + 5).alias("start"), F.get(at, i + 1).alias("end")),
            ),
        )
        return F.filter(every, lambda s: s.isNotNull())

    return let(ends, spans)


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (chosen, rejected: array<struct<role, text>>, and further columns) with n_common, prompt, chosen and rejected completions and their masks.

    prompt is the common prefix, rendered once; *_completion the rest of each side, *_mask its spans. Null arrays count as empty; in turns a null
    role or text counts as ''. Equal conversations: all is prompt, the completions are empty. Rows in, rows out.
    """
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    def rest(turns: Column, n: Column) -> Column:
        return let(F.slice(turns, n + 1, F.size(turns)), lambda r: F.struct(rendered(r).alias("completion"), mask(r).alias("mask")))

    out = let(
        F.struct(clean("chosen").alias("c"), clean("rejected").alias("r")),
        lambda p: let(
            common_turns(p["c"], p["r"]),
            lambda n: F.struct(n.alias("n_common"), rendered(F.slice(p["c"], F.lit(1), n)).alias("prompt"), rest(p["c"], n).alias("c"), rest(p["r"], n).alias("r")),
        ),
    )
    names = ("n_common", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask", "_p")
    keep = [F.col(f"`{c}`") for c in pairs.columns if c not in names]
    return pairs.withColumn("_p", out).select(
        *keep, "_p.n_common", "_p.prompt", F.col("_p.c.completion").alias("chosen_completion"), F.col("_p.c.mask").alias("chosen_mask"),
        F.col("_p.r.completion").alias("rejected_completion"), F.col("_p.r.mask").alias("rejected_mask"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns (role, text) in order of turn, then role, then text; identical rows count once, rows without conv_id or turn not at all."""
    ok = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    grouped = ok.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation as chosen; as rejected the same up to its last learned turn, then what its neighbour (conv_id with the lowest bit turned) answered last.

    Without a neighbour, or if that has no learned turn, nothing follows; a conversation without a learned turn is rejected with that answer after all its turns.
    """
    whole = conversations(turns)
    ok = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & (F.col("role") == LEARNED))
    last = ok.groupBy(F.col("conv_id").bitwiseXOR(1).alias("conv_id")).agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", F.col("m.text").alias("other"))
    n = let(F.transform("turns", lambda t: t["role"] == LEARNED), lambda is_learned: F.size(is_learned) - F.array_position(F.reverse(is_learned), True).cast("int"))
    answer = F.when(F.col("other").isNull(), F.slice("turns", 1, 0)).otherwise(F.array(F.struct(F.lit(LEARNED).alias("role"), F.col("other").alias("text"))))
    return whole.join(last, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), n), answer).alias("rejected"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_pairs(conversation_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select(
        "conv_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_completion", spans("chosen_mask").alias("chosen_mask"),
        "rejected_completion", spans("rejected_mask").alias("rejected_mask"),
    )


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
l AS (SELECT conv_id, coalesce(max(i) FILTER (role = '{LEARNED}'), max(i) + 1) AS cut FROM n GROUP BY conv_id),
a AS (SELECT xor(conv_id, 1) AS conv_id, arg_max(text, turn) AS other FROM t WHERE role = '{LEARNED}' GROUP BY conv_id),
r AS (SELECT n.conv_id, i, role, text FROM n JOIN l USING (conv_id) WHERE i < cut
      UNION ALL SELECT l.conv_id, cut, '{LEARNED}', other FROM l JOIN a USING (conv_id) WHERE other IS NOT NULL),
d AS (SELECT n.conv_id, n.i FROM n LEFT JOIN r ON n.conv_id = r.conv_id AND n.i = r.i AND n.role = r.role AND n.text = r.text WHERE r.conv_id IS NULL
      UNION ALL SELECT conv_id, max(i) + 1 FROM n GROUP BY conv_id),
c AS (SELECT conv_id, min(i) - 1 AS n_common FROM d GROUP BY conv_id),
s AS (SELECT 'c' AS side, conv_id, i, role, text FROM n UNION ALL SELECT 'r', conv_id, i, role, text FROM r),
x AS (SELECT s.*, n_common, '<|' || role || '|>' || chr(10) || text || chr(10) AS piece FROM s JOIN c USING (conv_id)),
y AS (SELECT *, sum(length(piece)) OVER (PARTITION BY side, conv_id ORDER BY i) AS stop FROM x WHERE i > n_common),
p AS (SELECT conv_id, string_agg(piece, '' ORDER BY i) AS prompt FROM x WHERE side = 'c' AND i <= n_common GROUP BY conv_id),
z AS (SELECT side, conv_id, string_agg(piece, '' ORDER BY i) AS completion,
        string_agg(CAST(stop - length(text) - 1 AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY i) FILTER (role = '{LEARNED}') AS mask
      FROM y GROUP BY side, conv_id)
SELECT c.conv_id, CAST(n_common AS BIGINT) AS n_common, coalesce(prompt, '') AS prompt, coalesce(zc.completion, '') AS chosen_completion, coalesce(zc.mask, '') AS chosen_mask,
  coalesce(zr.completion, '') AS rejected_completion, coalesce(zr.mask, '') AS rejected_mask
FROM c LEFT JOIN p USING (conv_id) LEFT JOIN (SELECT * FROM z WHERE side = 'c') zc USING (conv_id) LEFT JOIN (SELECT * FROM z WHERE side = 'r') zr USING (conv_id)
"""
