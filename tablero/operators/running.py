"""Running sums, ranks and row numbers over groups of any size.

A window over one whole group puts that group into one task. Here the ordered axis of a group is cut into buckets of a fixed
width. The windows run inside a bucket and over the bucket totals, both of bounded size, and every result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    points: DataFrame, group: list[str], axis: str, bucket: Column, sums: list[str], descending: bool = False,
    coarser: tuple[int, ...] = (),
) -> DataFrame:
    """Adds ``<c>_antes``: the sum of ``c`` over the points of the group that come before on the axis.

    ``points`` holds one row per (group, axis value). ``bucket``, a whole number, must not decrease along the axis; a window holds
    the distinct axis values of one bucket, the other one row per bucket of a group. With ``coarser`` widths the buckets are
    themselves cut into buckets of so many, and so on, so that every window stays small.
    """

    def ordered(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    marked = points.withColumn("_cubo", bucket)
    totals = marked.groupBy(*group, "_cubo").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    if coarser:
        level = totals.select(*group, F.col("_cubo").alias("_eje"), *[F.col(f"_t_{c}") for c in sums])
        level = running_sums(
            level, group, "_eje", F.floor(F.col("_eje") / coarser[0]), [f"_t_{c}" for c in sums], descending, coarser[1:])
        offsets = level.select(*group, F.col("_eje").alias("_cubo"), *[F.col(f"_t_{c}_antes").alias(f"_o_{c}") for c in sums])
    else:
        earlier_buckets = Window.partitionBy(*group).orderBy(ordered("_cubo")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*group, "_cubo", *[F.sum(f"_t_{c}").over(earlier_buckets).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*group, "_cubo").orderBy(ordered(axis)).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    zero = F.lit(0)
    return local.join(offsets, [*group, "_cubo"]).select(
        *points.columns,
        *[(F.coalesce(f"_o_{c}", zero) + F.coalesce(f"_l_{c}", zero)).alias(f"{c}_antes") for c in sums])


def running_best(
    points: DataFrame, group: list[str], axis: str, bucket: Column, value: str, coarser: tuple[int, ...] = (), descending: bool = False
) -> DataFrame:
    """Adds ``<value>_antes``: the least ``value`` of the group's points that come before on the axis, null where there is none.

    ``value`` may be a struct, whose later fields then say whose value it is. Buckets and ``coarser`` widths are those of
    :func:`running_sums`.
    """
    out = f"{value}_antes"

    def ordered(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    marked = points.withColumn("_cubo", bucket)
    best = marked.groupBy(*group, "_cubo").agg(F.min(value).alias("_m"))
    if coarser:
        level = best.select(*group, F.col("_cubo").alias("_eje"), "_m")
        level = running_best(level, group, "_eje", F.floor(F.col("_eje") / coarser[0]), "_m", coarser[1:], descending)
        offsets = level.select(*group, F.col("_eje").alias("_cubo"), F.col("_m_antes").alias("_o"))
    else:
        earlier_buckets = Window.partitionBy(*group).orderBy(ordered("_cubo")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = best.select(*group, "_cubo", F.min("_m").over(earlier_buckets).alias("_o"))
    inside = Window.partitionBy(*group, "_cubo").orderBy(ordered(axis)).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_l", F.min(value).over(inside)).join(offsets, [*group, "_cubo"])
    return local.select(*points.columns, F.least("_l", "_o").alias(out))


def value_ranks(
    df: DataFrame, group: list[str], value: str, width: int, descending: bool = False, coarser: tuple[int, ...] = ()
) -> DataFrame:
    """One row per (group, whole-number value) with ``puesto`` (gaps after ties) and ``denso`` (no gaps).

    Equal values are counted before anything is ordered, so a value shared by most of a group is one row. A bucket spans
    ``width`` consecutive values and so never holds more points than that.
    """
    points = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_uno", F.lit(1).cast("long"))
    bucket = F.floor(F.col(value) / width)
    ranked = running_sums(points, group, value, bucket, ["_n", "_uno"], descending, coarser)
    return ranked.select(
        *group, value, (F.col("_n_antes") + 1).alias("puesto"), (F.col("_uno_antes") + 1).alias("denso"))


def number_rows(df: DataFrame, key: list[str], out: str, after: Column | None = None, digits: int = 3) -> DataFrame:
    """Numbers the rows 1, 2, 3, ... without gaps, in the order of the digest of a unique key.

    The digest spreads any set of keys evenly over ``16 ** digits`` buckets, and the bucket offsets are one short table of at
    most that many rows, which is what the broadcast below rests on.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    marked = df.withColumn("_huella", F.md5(text)).withColumn("_cubo", F.substring("_huella", 1, digits))
    sizes = marked.groupBy("_cubo").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cubo").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_cubo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_desde"))
    local = marked.withColumn("_local", F.row_number().over(Window.partitionBy("_cubo").orderBy("_huella", *key)))
    number = F.col("_desde") + F.col("_local")
    if after is not None:
        number = number + after
    return local.join(F.broadcast(offsets), "_cubo").select(*df.columns, number.cast("long").alias(out))
