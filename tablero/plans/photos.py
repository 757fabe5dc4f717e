"""Photos kept as hexadecimal text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablero.plans.views import _only
from tablero.schema import ENUMS
from tablero.sources.tables import Tables


def decode(photos: DataFrame) -> DataFrame:
    """Adds the bytes of each photo; text that is not hexadecimal gives null."""
    return photos.withColumn("contenido", F.try_to_binary("archivo", F.lit("hex")))


def _photos(t: Tables, reto: str | None, retador: str | None) -> DataFrame:
    if reto is None and retador is None:
        return t.fotos
    people = _only(t.participacion, reto, retador).select("id_participacion")
    return t.fotos.join(people, "id_participacion", "left_semi")


def photos_decoded(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Size and digest of each photo, computed where it lies; the bytes themselves are never shuffled."""
    return decode(_photos(t, reto, retador)).select(
        "id_foto", "id_participacion", "tipo", "estado", F.length("contenido").cast("long").alias("n_bytes"),
        F.md5("contenido").alias("md5"))


def pivot_photos(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Digests of the first and the last photo per kind, kinds in their declared order."""
    order = F.array_position(F.array(*[F.lit(k) for k in ENUMS["tipo_foto"]]), F.col("tipo"))
    states = [F.max(F.when(F.col("estado") == s, F.col("md5"))).alias(s.lower()) for s in ENUMS["estado_foto"]]
    rows = photos_decoded(t, reto=reto, retador=retador).groupBy("id_participacion", "tipo").agg(*states)
    return rows.orderBy("id_participacion", order)


def photos_encode(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (path, archivo), the bytes in hexadecimal text ready to be stored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.lower(F.hex("content")).alias("archivo"))
