"""A place for every row of a table in a given order, without one task that holds the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablero.operators.stored import stored

#: Within a partition Spark numbers rows in the lowest 33 bits.
LOCAL = (1 << 33) - 1


def parts(spark: SparkSession) -> int:
    """How many tasks share rows that are sorted whole. A given number is not brought together by compressed size: texts that compress well would make
    sorts of several GB of it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt by ranges of an order and written once to the session's shared folder, each with its range (``_rango``) and its place in it
    (``_lugar``, from 0)."""
    ranged = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_rango", F.spark_partition_id())
    return stored(ranged.withColumn("_lugar", F.monotonically_increasing_id().bitwiseAND(LOCAL)))


def positioned(df: DataFrame, order: list[Column], out: str = "posicion") -> DataFrame:
    """The rows with their place 1, 2, 3, ... in an order, which should end with a unique key: then no value, however common, keeps its rows in one
    task.

    The sizes of the ranges, one row per task that wrote, give the places where they begin; that is the bound of the broadcast below.
    """
    kept = by_ranges(df, order)
    sizes = kept.groupBy("_rango").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_rango").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_rango", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_desde"))
    return kept.join(F.broadcast(starts), "_rango").select(*df.columns, (F.col("_desde") + F.col("_lugar") + 1).alias(out))


def write_in_order(rows: DataFrame, path: str, position: str = "posicion") -> None:
    """Writes positioned rows to a new place so that files and rows within them follow the position: a reader that asks for a range of positions skips
    the others by their statistics."""
    rows.repartitionByRange(position).sortWithinPartitions(position).write.mode("errorifexists").parquet(path)
