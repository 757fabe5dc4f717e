"""The stored tables of the domain as lazily opened DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablero.schema import CONCEPT_WEIGHTS, CRITERION_WEIGHTS, HABIT_WEIGHTS, PARAMETER_UNITS, SCHEMAS, WEIGHT_TABLES

READERS = {"parquet", "orc", "json", "csv"}


def load(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One stored table from ``path/table`` with its declared schema, never an inferred one."""
    if fmt not in READERS:
        raise ValueError(f"formato no soportado: {fmt}")
    reader = spark.read.format(fmt).schema(SCHEMAS[table])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{path.rstrip('/')}/{table}")


def save(df: DataFrame, path: str, table: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write one table to a new place; an existing one is an error, so no path is overwritten while it is read."""
    writer = df.write.format(fmt).mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{path.rstrip('/')}/{table}")


class Tables:
    """Named DataFrames, each opened when first asked for: ``t.retos``, ``t["raw_habitos"]``."""

    def __init__(self, spark: SparkSession, opener: Callable[[str], DataFrame], frames: dict[str, DataFrame] | None = None):
        self.spark = spark
        self._opener = opener
        self._frames = dict(frames or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._opener(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self[name]

    def replace(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them swapped, for instance raw instead of clean ones."""
        return Tables(self.spark, self._opener, {**self._frames, **frames})

    @classmethod
    def load(cls, spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
        return cls(spark, lambda name: load(spark, path, name, fmt))

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> Tables:
        """Given frames, the seed rows for the four dimensions and empty typed tables for the rest."""

        def opener(name: str) -> DataFrame:
            if name in SEEDS:
                return seed(spark, name)
            return spark.createDataFrame([], SCHEMAS[name])

        return cls(spark, opener, frames)


SEEDS = {
    "conceptos": CONCEPT_WEIGHTS,
    "habitos": HABIT_WEIGHTS,
    "criterios_calificacion": CRITERION_WEIGHTS,
    "parametros": PARAMETER_UNITS,
}


def seed(spark: SparkSession, table: str) -> DataFrame:
    """The rows a fresh installation starts with."""
    schema = SCHEMAS[table]
    rows = [(i, *row) for i, row in enumerate(SEEDS[table], start=1)]
    text = spark.createDataFrame(rows, f"{schema[0].name} int, {schema[1].name} string, {schema[2].name} string")
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def seed_weights(t: Tables) -> DataFrame:
    """The three weight tables as one list (tabla, nombre, peso)."""
    parts = [
        t[table].select(F.lit(table).alias("tabla"), F.col(name).alias("nombre"), F.col(weight).cast("double").alias("peso"))
        for table, name, weight in WEIGHT_TABLES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
