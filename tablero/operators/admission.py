"""Admission in order: which intervals of a batch are kept when each must miss all that were kept before it, and which groups of a batch when each
must share no member with those kept before it.

Both are greedy choices that look sequential. Here neither passes a group through one task: the first follows a path by pointer
jumping, the second decides in every round all that no open predecessor can touch any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.operators.overlap import LEVELS, second_of
from tablero.operators.running import running_best
from tablero.operators.stored import stored

#: Rows of a group that are gone through in order as one list.
FEW = 4096


def first_free(df: DataFrame, group: str, start: str, end: str, few: int = FEW) -> DataFrame:
    """The rows of ``df``, one per (group, start) with start <= end, that are admitted in the order of their start: each begins after
    the end of the one admitted before it.

    A group of up to ``few`` rows is one list, which is gone through in order. The others are spread over all tasks, whatever their size
    (:func:`_path`).
    """
    rows = stored(df)
    crowded = stored(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select(group))
    instant, rest = df.schema[start].dataType, [c for c in df.columns if c not in (group, start)]
    lists = rows.join(crowded, group, "left_anti").groupBy(group).agg(F.array_sort(F.collect_list(F.struct(start, *rest))).alias("_filas"))
    admitted = F.aggregate(
        "_filas", F.struct(F.lit(None).cast(instant).alias("hasta"), F.slice("_filas", 1, 0).alias("quedan")),
        lambda held, row: F.when(held["hasta"].isNull() | (row[start] > held["hasta"]), F.struct(
            row[end].alias("hasta"), F.array_append(held["quedan"], row).alias("quedan"))).otherwise(held),
        lambda held: held["quedan"])
    kept = lists.select(group, F.inline(admitted)).select(*df.columns)
    if crowded.isEmpty():
        return kept
    return kept.unionByName(_path(rows.join(crowded, group, "left_semi").select(*df.columns), group, start, end))


def _path(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """The admitted rows of groups of any size.

    After a row the next admitted one is the first that starts later than it ends. So all rows point to one successor, and the admitted ones are
    the path from the first row of the group. Its first 2^k rows are known after k rounds; each round is two joins by row.
    """
    instants = df.select(group, F.inline(F.array(
        F.struct(F.col(start).alias("_t"), F.col(start).alias("_ini")),
        F.struct(F.col(end).alias("_t"), F.lit(None).cast(df.schema[start].dataType).alias("_ini")))))
    points = instants.groupBy(group, "_t").agg(F.min("_ini").alias("_ini"))
    line = running_best(points, [group], "_t", second_of("_t"), "_ini", LEVELS, descending=True)
    after = line.select(group, F.col("_t").alias(end), F.col("_ini_antes").alias("_sigue"))
    rows = stored(df.join(after, [group, end]))
    jump = rows.filter(F.col("_sigue").isNotNull()).select(group, F.col(start).alias("_de"), F.col("_sigue").alias("_a"))
    path = stored(rows.groupBy(group).agg(F.min(start).alias("_de")))
    while True:
        reached = stored(path.join(jump, [group, "_de"]).select(group, F.col("_a").alias("_de")))
        if reached.isEmpty():
            break
        path = path.unionByName(reached)
        onward = jump.select(group, F.col("_de").alias("_a"), F.col("_a").alias("_lejos"))
        jump = stored(jump.join(onward, [group, "_a"]).select(group, "_de", F.col("_lejos").alias("_a")))
    return rows.join(path.select(group, F.col("_de").alias(start)), [group, start], "left_semi").select(*df.columns)


def independent_groups(members: DataFrame, taken: DataFrame, group: str, member: str, order: str) -> DataFrame:
    """The groups that are admitted in ``order`` (unique per group): none shares a member with ``taken`` or with a group admitted before it.

    ``members`` holds the distinct (member, group) with the group's order, ``taken`` distinct members. In each round the groups with a taken member
    go, and those that come first for all their members are admitted; at least the first open group is decided. No pairs
    of groups are formed; a member of many groups and a group of many members are partial aggregates.
    """
    open_, admitted = members, []
    while True:
        touched = open_.join(taken, member, "left_semi").select(group).distinct()
        rest = stored(open_.join(touched, group, "left_anti"))
        first = rest.groupBy(member).agg(F.min(order).alias("_primero"))
        leads = rest.join(first, member).groupBy(group).agg(F.bool_and(F.col(order) == F.col("_primero")).alias("_gana"))
        won = stored(leads.filter("_gana").select(group))
        if won.isEmpty():
            break
        admitted.append(won)
        taken = stored(rest.join(won, group, "left_semi").select(member).distinct())
        open_ = rest.join(won, group, "left_anti")
    found = members.select(group).limit(0)
    for won in admitted:
        found = found.unionByName(won)
    return found
