"""Intermediate tables that steps in rounds write once and read back, so that no step is computed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A session on one machine that names none gets its own; a cluster must
    name one, since a folder of one machine would lose rows there."""
    named = spark.conf.get(FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"falta {FOLDER}: una carpeta compartida por todos los nodos")
        named = "file://" + tempfile.mkdtemp(prefix="tablero-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here, a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/tabla-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(StructType(df.schema.fields)).parquet(path)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a side of a join, -1 for never."""
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(limit)


def fits(df: DataFrame) -> bool:
    """Whether the rows of a stored table, counted in the footers of its files, are within that limit at the usual width of their types. Spark goes by the
    size of the files, and packed rows may take a hundred times that on the driver."""
    return df.count() * df._jdf.schema().defaultSize() <= broadcast_limit(df.sparkSession)


def weighed(df: DataFrame) -> DataFrame:
    """A stored table as its next join should weigh it: by sort where its rows are too many to be broadcast, else as Spark decides."""
    return df if fits(df) else df.hint("merge")
