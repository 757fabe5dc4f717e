"""Chat formatting: logs that were saved again and again as a conversation grew are collapsed to the longest, then rendered.

Each turn gets a digest of its place, role and text. The digests of a conversation's first turns, combined by exclusive or, identify
that prefix; two independent 64-bit combinations stand side by side. A conversation whose digest (of all its turns) is the digest of a proper
prefix of a longer one goes by an anti-join, and of conversations with equal turns the smallest id stays. The rest is rendered turn
by turn.

The place of a turn is its rank by (turn, role, text), nulls first. A conversation may hold any share of the rows: turns are dealt by
conversation and run of turn numbers, ranked and combined inside a run, and windows over one narrow row per run add what came before.
Rendered text stays one row per turn, with its place in characters, so that no task builds a whole conversation; a writer appends the
rows in order. Full digests and prefixes are reduced to one row each before they meet, so a prefix that very many logs share is one key.

Results for odd input: a repeated row (same conversation, number, role and text) is one turn. A null conversation id is a conversation of its
own. Null roles and texts count as empty. An empty text is a turn. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that one inner window takes.
RUN = 64


#: How a turn is rendered.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")
CONV, AT = ["conv", "nil"], ["conv", "nil", "run"]


def turns(logs: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Distinct turns with their run, dealt by conversation and run, and their rank inside the run."""
    kind = logs.schema[conv].dataType
    rows = logs.select(
        F.coalesce(F.col(conv), F.lit(0).cast(kind)).alias("conv"), F.isnull(conv).alias("nil"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / RUN).alias("run"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition(*AT).dropDuplicates()
    order = Window.partitionBy(*AT).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("inner", F.row_number().over(order))


def runs(rows: DataFrame, **totals: Column) -> DataFrame:
    """One row per run with totals of it and, under the same names with ``_before``, those of the conversation's earlier runs."""
    earlier = Window.partitionBy(*CONV).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"n": F.sum, "chars": F.sum, "d1": F.bit_xor, "d2": F.bit_xor}
    made = rows.groupBy(*AT).agg(*(value.alias(name) for name, value in totals.items()))
    return made.select(*AT, *totals, *(F.coalesce(combine[name](name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in totals))


def collapsed(logs: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The turns of maximal conversations: id, turn, position from 1, n_turns, start (characters rendered before it) and rendered."""
    opened, closed, end = TEMPLATE
    rows = turns(logs, conv)
    ranks = runs(rows, n=F.count("*")).drop("n")
    placed = rows.join(ranks, AT).select(*AT, "turn", "role", "text", "inner", (F.col("inner") + F.col("n_before")).alias("position"))
    seal = placed.select(*AT, "inner", "position", *(F.xxhash64(F.lit(k), "position", "role", "text").alias(f"d{k}") for k in (1, 2)))
    combined = runs(seal, n=F.count("*"), d1=F.bit_xor("d1"), d2=F.bit_xor("d2"))
    whole = combined.groupBy(*CONV).agg(F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    so_far = Window.partitionBy(*AT).orderBy("inner")
    inside = seal.select(*AT, "position", *(F.bit_xor(f"d{k}").over(so_far).alias(f"i{k}") for k in (1, 2)))
    prefixes = inside.join(combined.select(*AT, "d1_before", "d2_before"), AT).join(whole.select(*CONV, "n"), CONV).where("position < n")
    prefixes = prefixes.select(
        F.col("position").alias("n"), *(F.col(f"i{k}").bitwiseXOR(F.col(f"d{k}_before")).alias(f"d{k}") for k in (1, 2))).distinct()
    # Of equal conversations the smallest id; a null id counts as the largest.
    first = whole.groupBy("n", "d1", "d2").agg(F.min(F.struct("nil", "conv")).alias("own"))
    kept = first.join(prefixes, ["n", "d1", "d2"], "left_anti").select("own.conv", "own.nil", F.col("n").alias("n_turns"))
    shown = F.concat(F.lit(opened), "role", F.lit(closed), "text", F.lit(end))
    shown_rows = placed.select(*AT, "turn", "inner", "position", shown.alias("rendered"), F.length(shown).cast("long").alias("chars"))
    starts = runs(shown_rows, chars=F.sum("chars")).drop("chars").join(kept, CONV)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    inner = shown_rows.withColumn("ahead", F.coalesce(F.sum("chars").over(earlier), F.lit(0)))
    return inner.join(starts, AT).select(
        F.when(~F.col("nil"), F.col("conv")).alias(conv), "turn", F.col("position").cast("long").alias("position"), F.col("n_turns").cast("long").alias("n_turns"),
        (F.col("ahead") + F.col("chars_before")).cast("long").alias("start"), "rendered")


#: The same rows by comparing whole prefixes as text, for small tables.
SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER w AS prefix,
    concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (SELECT min(conv_id) AS conv_id FROM p f WHERE position = n_turns
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.position < q.n_turns AND q.position = f.n_turns AND q.prefix = f.prefix) GROUP BY prefix)
SELECT p.conv_id, turn, position, n_turns, rendered,
  CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY p.conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id
"""
