"""Preference formatting: a shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a turn is written.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n"


def _conversations(turns: DataFrame, name: str) -> DataFrame:
    """One row per pair: the turns of one side, in order of turn, role and text."""
    return turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias(name))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column, target: str) -> Column:
    """Spans ``start-end`` of the completion, in characters, on which a model trains: texts of the target role with their close."""
    frame, zero = len(OPEN) + len(AFTER_ROLE), F.lit(0).cast("long")
    state = F.struct(zero.alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + frame + F.length(t["role"])
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws("-", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == target, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, target: str = "assistant") -> DataFrame:
    """Format pairs of conversations given as turns (pair_id, turn, role, text).

    One row per pair_id of either side: n_common (turns of the longest common prefix,
    equal in role and text), prompt (those turns, rendered once), chosen and rejected
    (the other turns, rendered) and chosen_mask and rejected_mask (the character spans
    of the completion to train on: texts of the target role). Turns are taken in
    order of turn number, then role and text; a repeated row is a turn of its own. A
    null role or text counts as empty. A side without turns gives an empty
    completion, and equal conversations two. Rows with a null pair_id form one pair.
    Other columns are ignored. Each pair's turns are gathered once, a side at a time.
    """
    both = _conversations(chosen, "c").join(_conversations(rejected, "r").withColumnRenamed("pair_id", "other"), F.col("pair_id").eqNullSafe(F.col("other")), "full")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = both.select(F.coalesce("pair_id", "other").alias("pair_id"), F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    short = F.least(F.size("c"), F.size("r"))
    same = lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"])
    differ = F.filter(F.when(short > 0, F.sequence(F.lit(0), short - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~same(i))
    both = both.withColumn("n", F.coalesce(F.get(differ, F.lit(0)), short))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _mask(F.col("c"), target).alias("chosen_mask"), _mask(F.col("r"), target).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs without labels: conversation 2k as chosen and 2k + 1 as rejected, pair_id ``n<k>``; turns without a conv_id are in none."""
    k = F.concat(F.lit("n"), F.expr("(conv_id - pmod(conv_id, 2)) div 2").cast("string"))
    of = lambda rest: turns.where(F.pmod("conv_id", F.lit(2)) == rest).select(k.alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return of(0), of(1)


def stale_answers(turns: DataFrame, target: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Pairs from single conversations: the last answer as given is chosen, the answer before it, repeated, rejected.

    Every conversation with two turns of the target role or more gives the pair
    ``s<conv_id>``; turns after its last answer are left out, and so are those without a
    conv_id or a turn number. Of several answers of one number the greatest text counts, a null one as empty.
    """
    answer = F.col("role") == target
    last = turns.where(answer).groupBy("conv_id").agg(F.max("turn").alias("last"))
    upto = turns.join(last, "conv_id").where(F.col("turn") <= F.col("last"))
    before = upto.where(answer & (F.col("turn") < F.col("last"))).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("stale"), F.lit(True).alias("has"))
    both = upto.join(before, "conv_id").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "stale", (answer & (F.col("turn") == F.col("last"))).alias("final"))
    return both.select("pair_id", "turn", "role", "text"), both.select("pair_id", "turn", "role", F.when(F.col("final"), F.col("stale")).otherwise(F.col("text")).alias("text"))


def conversation_preferences(turns: DataFrame) -> DataFrame:
    """Preference pairs of a table of conversations: neighbours and stale answers."""
    a, b = zip(neighbours(turns), stale_answers(turns))
    return preference_pairs(a[0].unionByName(a[1]), b[0].unionByName(b[1]))


_SIDE = """
SELECT pair_id, turn, coalesce(role, '') AS role, coalesce({text}, '') AS text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce({text}, '')) AS i FROM {source}"""
_REST = """
SELECT pair_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY i) AS body,
  string_agg(CASE WHEN role = 'assistant' THEN (stop - length(text) - 1) || '-' || stop END, ',' ORDER BY i) AS mask
FROM (SELECT *, CAST(sum(length(role) + length(text) + 6) OVER (PARTITION BY pair_id ORDER BY i) AS BIGINT) AS stop FROM {side} JOIN n USING (pair_id) WHERE i > n_common) GROUP BY pair_id"""
SQL = f"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT conv_id, stale FROM (SELECT conv_id, coalesce(text, '') AS stale, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS i FROM t JOIN l USING (conv_id) WHERE role = 'assistant' AND turn < last) WHERE i = 1),
s AS (SELECT 's' || conv_id AS pair_id, turn, role, text, CASE WHEN role = 'assistant' AND turn = last THEN stale ELSE text END AS other FROM t JOIN l USING (conv_id) JOIN b USING (conv_id) WHERE turn <= last),
c0 AS (SELECT 'n' || conv_id // 2 AS pair_id, turn, role, text FROM t WHERE conv_id % 2 = 0 UNION ALL SELECT pair_id, turn, role, text FROM s),
r0 AS (SELECT 'n' || (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, turn, role, text FROM t WHERE conv_id % 2 <> 0 UNION ALL SELECT pair_id, turn, role, other FROM s),
c AS ({_SIDE.format(text="text", source="c0")}),
r AS ({_SIDE.format(text="text", source="r0")}),
p AS (SELECT pair_id FROM c UNION SELECT pair_id FROM r),
m AS (SELECT pair_id, c.i FROM c JOIN r USING (pair_id, i) WHERE c.role = r.role AND c.text = r.text),
n AS (SELECT p.pair_id, coalesce(max(k), 0) AS n_common FROM p LEFT JOIN (SELECT pair_id, i AS k, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS j FROM m) q ON p.pair_id = q.pair_id AND k = j GROUP BY p.pair_id),
h AS (SELECT pair_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY i) AS prompt FROM c JOIN n USING (pair_id) WHERE i <= n_common GROUP BY pair_id),
cc AS ({_REST.format(side="c")}),
rr AS ({_REST.format(side="r")})
SELECT n.pair_id, n.n_common, coalesce(prompt, '') AS prompt, coalesce(cc.body, '') AS chosen, coalesce(rr.body, '') AS rejected, coalesce(cc.mask, '') AS chosen_mask, coalesce(rr.mask, '') AS rejected_mask
FROM n LEFT JOIN h USING (pair_id) LEFT JOIN cc USING (pair_id) LEFT JOIN rr USING (pair_id)"""
