"""Joins of many rows with one row per challenge, coach or catalogue entry, where a single key may hold a large part of the rows.

A table that may be as large as the other side (instants, totals) is not repeated: those joins are plain inner or left joins with one row per key on
the right, whose left side adaptive execution divides where it measures a heavy key. Activities, of which one may be attended by very many, are
repeated ``FEW_SLOTS`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.operators.stored import broadcast_limit

SLOTS, FEW_SLOTS = 32, 4
#: Session setting with the number of parts; on a large cluster about the number of tasks that one key may take.
SETTING = "tablero.spread.slots"


def spread_join(
    df: DataFrame, per_key: DataFrame, key: list[str], by: list[str], how: str = "inner", slots: int | None = None
) -> DataFrame:
    """``df`` joined with ``per_key``, each key divided into ``slots`` parts by the columns ``by`` of ``df``.

    Where Spark takes the small side as it is for small enough to be broadcast, it is not repeated: nothing moves, so no key is heavy. Otherwise it is
    repeated once per part, and the rows of one key are shared by up to ``slots`` tasks. The copies are an ``unpivot``, since Spark counts those when it
    compares sizes (rows of an ``explode`` count once, and all copies would come to the driver where one is small). Later steps cannot mistake the
    result for data already grouped by key.
    """
    if key and estimated_size(per_key) <= broadcast_limit(df.sparkSession):
        return df.join(per_key, key, how)
    slots = slots or int(df.sparkSession.conf.get(SETTING, str(SLOTS)))
    parts = df.withColumn("_parte", F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int"))
    return parts.join(copies(per_key, slots), [*key, "_parte"], how).drop("_parte")


def estimated_size(df: DataFrame) -> int:
    """Bytes as Spark's optimizer estimates them before anything runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def copies(df: DataFrame, slots: int) -> DataFrame:
    """Each row once per part, numbered in ``_parte``."""
    numbers = [f"_parte_{n}" for n in range(slots)]
    wide = df.select("*", *[F.lit(n).alias(name) for n, name in enumerate(numbers)])
    return wide.unpivot(df.columns, numbers, "_copia", "_parte").drop("_copia")
