"""How many other intervals of its group each interval overlaps, and one of them, without forming the pairs.

With closed ends, the intervals that miss [a, b] either start after b or end before a, and none does both. So the number that
meet it is (starts up to b) - (ends before a), and both are running sums along the timeline of the group. The cost is a sort of
the distinct instants, also where all intervals of a group overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.operators.running import running_best, running_sums
from tablero.operators.spread import spread_join
from tablero.operators.stored import stored

#: Hours of seconds and years of hours: at most a million instants in a window over seconds, then 3,600, then 8,784.
LEVELS = (3_600, 8_784)
#: Intervals of a group that may meet each row of another table as a list, and the number of copies of such a list.
FEW, LIST_SLOTS = 256, 4


def second_of(instant: str) -> Column:
    return F.unix_date(F.to_date(instant)).cast("long") * 86_400 + F.hour(instant) * 3_600 + F.minute(instant) * 60 + F.second(instant)


def proper(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows with a group and an interval; the others overlap nothing."""
    return df.filter(F.col(group).isNotNull() & (F.col(start) <= F.col(end)))


def overlap_counts(df: DataFrame, group: str, start: str, end: str, out: str = "solapes", among: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """``df`` with the number of *other* rows of the group that share at least one instant with the row, or of the rows ``among`` another table
    with the same columns.

    Rows without a group or without a proper interval (start after end, null bounds) overlap nothing and are left out. Where ``among`` has up to
    ``few`` rows in a group, they come to the rows of ``df`` as two short lists; only larger groups pass through the timeline. Which ones these are is found
    and written to the session's shared folder while this is called.
    """
    rows, others = proper(df, group, start, end), None if among is None else proper(among, group, start, end)
    if others is None:
        return _along(rows, None, df.columns, group, start, end, out)
    crowded = stored(others.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).select(group))
    lists = others.join(crowded, group, "left_anti").groupBy(group).agg(F.collect_list(start).alias("_de"), F.collect_list(end).alias("_a"))
    near = spread_join(rows.join(crowded, group, "left_anti"), lists, [group], [start, end], "left", LIST_SLOTS)
    met = F.size(F.filter("_de", lambda x: x <= F.col(end))) - F.size(F.filter("_a", lambda x: x < F.col(start)))
    counted = near.select(*df.columns, F.when(F.col("_de").isNull(), 0).otherwise(met).cast("long").alias(out))
    if crowded.isEmpty():
        return counted
    far = _along(rows.join(crowded, group, "left_semi"), others.join(crowded, group, "left_semi"), df.columns, group, start, end, out)
    return counted.unionByName(far)


def _along(rows: DataFrame, others: DataFrame | None, columns: list[str], group: str, start: str, end: str, out: str) -> DataFrame:
    """The counts by running sums along the timeline of each group, however large."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def ends(x: DataFrame, counts: bool) -> DataFrame:
        own = one if counts else none
        return x.select(group, F.inline(F.array(
            F.struct(F.col(start).alias("_t"), own.alias("_ini"), none.alias("_fin")),
            F.struct(F.col(end).alias("_t"), none.alias("_ini"), own.alias("_fin")))))

    events = ends(rows, True) if others is None else ends(rows, False).unionByName(ends(others, True))
    instants = events.groupBy(group, "_t").agg(F.sum("_ini").alias("_ini"), F.sum("_fin").alias("_fin"))
    line = running_sums(instants, [group], "_t", second_of("_t"), ["_ini", "_fin"], coarser=LEVELS)
    starts = line.select(group, F.col("_t").alias(end), (F.col("_ini_antes") + F.col("_ini")).alias("_hasta_fin"))
    before = line.select(group, F.col("_t").alias(start), F.col("_fin_antes").alias("_antes_inicio"))
    # One row per instant on the right: where many rows share an instant, Spark divides them as measured.
    met = rows.join(starts, [group, end]).join(before, [group, start])
    return met.select(*columns, (F.col("_hasta_fin") - F.col("_antes_inicio") - (1 if others is None else 0)).alias(out))


def overlap_witness(df: DataFrame, group: str, start: str, end: str, key: str, out: str = "testigo") -> DataFrame:
    """Each row that overlaps another one of its group, with the ``key`` of one such row.

    That is the smallest key with the same start (for that row itself the largest one); where there is no other, the row that starts earlier and lasts longest (of
    equals the smallest key) if it lasts long enough; else the smallest key at the next start, if that is in time. Only starts are
    ordered, each with the best row that begins there, so that a start shared by most of a group is one row.
    """
    rows = proper(df, group, start, end).withColumn("_s", F.col(start))
    # Per start its smallest and largest key and the row that lasts longest; the least of (-length, key) ends last.
    longest = F.min(F.struct((-second_of(end)).alias("_menos"), F.col(key).alias("_quien")))
    points = rows.groupBy(group, "_s").agg(F.min(key).alias("_uno"), F.max(key).alias("_dos"), longest.alias("_largo"))
    ahead = running_best(points, [group], "_s", second_of("_s"), "_largo", LEVELS)
    points = ahead.withColumn("_sig", F.struct("_s", F.col("_uno").alias("_quien")))
    line = running_best(points, [group], "_s", second_of("_s"), "_sig", LEVELS, descending=True)
    known = rows.join(line, [group, "_s"])
    same = F.when(F.col(key) != F.col("_uno"), F.col("_uno")).when(F.col(key) != F.col("_dos"), F.col("_dos"))
    earlier = F.when(-F.col("_largo_antes._menos") >= second_of("_s"), F.col("_largo_antes._quien"))
    later = F.when(F.col("_sig_antes._s") <= F.col(end), F.col("_sig_antes._quien"))
    return known.select(*df.columns, F.coalesce(same, earlier, later).alias(out)).filter(F.col(out).isNotNull())
