"""Continuous intake of habit rows: the first registration of a (person, day, habit) is kept, rows that break a rule are set
aside with the reasons."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablero.operators.changes import first_by
from tablero.plans.quality import dated_people, habit_reasons
from tablero.plans.saving import general_reasons
from tablero.schema import SCHEMAS
from tablero.sources.tables import Tables

KEY = ["id_participacion", "fecha_ocurrencia", "nombre_habito"]
ORDER = ["id_registro_habito"]
COLUMNS = [f.name for f in SCHEMAS["registros_habitos"]]
ACCEPTED, REJECTED = "aceptados", "rechazados"


def read_habit_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Habit rows from a folder of Parquet files as they arrive."""
    reader = spark.readStream.schema(SCHEMAS["registros_habitos"])
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def judged(t: Tables, rows: DataFrame, as_of: date) -> DataFrame:
    """Habit rows with the list ``motivos`` of the rules they break."""
    known = F.when(F.col("fecha_ini").isNotNull(), habit_reasons(as_of)).otherwise(F.array().cast("array<string>"))
    return rows.join(dated_people(t), "id_participacion", "left").select(*COLUMNS, F.concat(general_reasons(), known).alias("motivos"))


def valid_habits(t: Tables, rows: DataFrame, as_of: date) -> DataFrame:
    """The batch counterpart of the intake over all rows at once."""
    kept = judged(t, rows, as_of).filter(F.size("motivos") == 0).select(*COLUMNS)
    return first_by(kept, KEY, ORDER)


def _stored_schema() -> str:
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["registros_habitos"] if f.name not in KEY[1:2])
    return f"{plain}, fecha_ocurrencia date, lote bigint"


def accepted(spark: SparkSession, out: str) -> DataFrame:
    """All rows taken in so far, with the batch that brought them."""
    return spark.read.schema(_stored_schema()).parquet(f"{out}/{ACCEPTED}")


def rejected(spark: SparkSession, out: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS["registros_habitos"])
    return spark.read.schema(f"{schema}, motivos array<string>, lote bigint").parquet(f"{out}/{REJECTED}")


def _store(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces exactly the partitions that ``df`` holds, so that a repeated batch leaves no duplicates."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def take_in(t: Tables, batch: DataFrame, batch_id: int, out: str, as_of: date) -> None:
    """One micro-batch, judged once. Only stored rows of the days that occur in the batch are read back for comparison."""
    spark = t.spark
    rows = judged(t, batch, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sound = F.size("motivos") == 0
        bad = rows.filter(~sound).withColumn("lote", F.lit(batch_id).cast("long"))
        _store(bad, f"{out}/{REJECTED}", "lote")
        days = rows.agg(F.min("fecha_ocurrencia"), F.max("fecha_ocurrencia")).first()
        if days is None or days[0] is None:
            return
        stored = accepted(spark, out).filter(F.col("fecha_ocurrencia").between(days[0], days[1]) & (F.col("lote") < batch_id))
        fresh = first_by(rows.filter(sound).select(*COLUMNS), KEY, ORDER).join(stored.select(*KEY), KEY, "left_anti")
        _store(fresh.withColumn("lote", F.lit(batch_id).cast("long")), f"{out}/{ACCEPTED}", "fecha_ocurrencia", "lote")
    finally:
        rows.unpersist()


def compact(spark: SparkSession, out: str, to: str) -> None:
    """What an intake has stored so far, in a new place with one folder per day (and one for all rejected rows). The intake goes
    on there under the same checkpoint; run it while the query is stopped."""
    day = accepted(spark, out).withColumn("lote", F.lit(-1).cast("long"))
    # One file per day and task, not per day and batch.
    day.repartition("fecha_ocurrencia", F.pmod(F.xxhash64("id_participacion"), F.lit(8))).write.partitionBy("fecha_ocurrencia", "lote").parquet(f"{to}/{ACCEPTED}")
    rejected(spark, out).withColumn("lote", F.lit(-1).cast("long")).write.partitionBy("lote").parquet(f"{to}/{REJECTED}")


def start_intake(
    tables: Tables | Callable[[], Tables],
    rows: DataFrame,
    out: str,
    checkpoint: str,
    as_of: date | Callable[[DataFrame, int], date],
    once: bool = False,
) -> StreamingQuery:
    """Starts the intake of a stream of habit rows into ``out``. ``checkpoint`` is a folder every executor can reach.

    ``tables`` as a function opens the tables anew for each batch, so that later enrolments count; ``as_of`` as a function of the batch and
    its number gives each batch its day. With ``once`` the query takes what is there and stops.
    """
    def opened() -> Tables:
        return tables() if callable(tables) else tables

    def day(batch: DataFrame, batch_id: int) -> date:
        return as_of(batch, batch_id) if callable(as_of) else as_of

    t = opened()
    empty = t.spark.createDataFrame([], SCHEMAS["registros_habitos"]).withColumn("lote", F.lit(0).cast("long"))
    empty.write.mode("append").partitionBy("fecha_ocurrencia", "lote").parquet(f"{out}/{ACCEPTED}")
    (empty.withColumn("motivos", F.array(F.lit(""))).write.mode("append").partitionBy("lote").parquet(f"{out}/{REJECTED}"))
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: take_in(opened(), batch, batch_id, out, day(batch, batch_id)))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
