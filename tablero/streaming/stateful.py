"""Continuous intake of habit rows that remembers what it took in Spark's state store instead of reading stored rows again.

For each person and day the state holds the habits taken so far, at most as many as there are habits. The first registration of a (person, day, habit)
is kept, within a batch the one with the smallest number; later ones leave no trace. Rows that break a rule are set aside with the reasons and
meet no state; they pass through in ``ASIDE`` parts, so that no missing or unknown person holds them all.

State must not grow for ever. A row counts only until ``grace`` days after its challenge is over; from then on it is set aside as ``reto_cerrado``, and the
event-time watermark, which follows the arrival of the rows, drops the state of that day. Rows are judged by the same arrival, so state never goes
while a row could still need it. Arrival is the time that Spark notes for the batch and repeats after a failure.

The tables are those that the query was started with: start it again (from its checkpoint) after enrolments. Results go to the folders that
:mod:`tablero.streaming.intake` reads; a repeated batch replaces its own partitions. A group is one person's day: repeats of one registration stream through its
task a chunk at a time. This is the one place of the main part that runs Python in tasks, once per person and day of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablero.plans.quality import dated_people, habit_reasons
from tablero.plans.saving import general_reasons
from tablero.sources.tables import Tables
from tablero.streaming.intake import ACCEPTED, COLUMNS, REJECTED, _store

#: Parts in which rows that are set aside pass.
ASIDE = 4096
GRACE = 30
REST = [c for c in COLUMNS if c not in ("id_registro_habito", "nombre_habito")]
OUT = "id_registro_habito long, id_participacion long, fecha_ocurrencia date, nombre_habito string, concepto string, nombre_coach string, fecha_registro date, motivos array<string>"


def judged_on_arrival(t: Tables, rows: DataFrame, arrival: Column, grace: int = GRACE) -> DataFrame:
    """Habit rows with the time of their arrival (``llegada``), the list ``motivos`` of the rules they break and the moment ``cierre`` (milliseconds) from
    which their challenge takes no more rows."""
    stamped = rows.select(*COLUMNS, arrival.cast("timestamp").alias("llegada"))
    joined = stamped.join(dated_people(t), "id_participacion", "left")
    day = F.to_date("llegada")
    end = F.date_add("fecha_fin_excl", grace)
    known = F.when(F.col("fecha_ini").isNotNull(), habit_reasons(day)).otherwise(F.array().cast("array<string>"))
    closed = F.when(day >= end, F.array(F.lit("reto_cerrado"))).otherwise(F.array().cast("array<string>"))
    return joined.select(*COLUMNS, "llegada", F.concat(general_reasons(), known, closed).alias("motivos"), F.unix_millis(end.cast("timestamp")).alias("cierre"))


def _take(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a batch adds for one person and day, or one part of the rows set aside."""
    if state.hasTimedOut:
        state.remove()
        return
    if key[2] >= 0:
        for chunk in chunks:
            yield chunk[[*COLUMNS, "motivos"]]
        return
    taken = set(state.get[0]) if state.exists else set()
    first, until = None, 0
    for chunk in chunks:
        until = int(chunk["cierre"].iloc[0])
        fresh = chunk[~chunk["nombre_habito"].isin(taken)]
        both = fresh if first is None else pd.concat([first, fresh])
        first = both.sort_values(["id_registro_habito", *REST], na_position="first").drop_duplicates("nombre_habito")
    state.update((sorted(taken | set(first["nombre_habito"])),))
    state.setTimeoutTimestamp(until)
    if len(first):
        yield first[[*COLUMNS, "motivos"]]


def taken(judged: DataFrame) -> DataFrame:
    """Of a stream of judged rows those to keep (without ``motivos``) and those set aside."""
    sound = F.size("motivos") == 0
    part = F.when(sound, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*COLUMNS), F.lit(ASIDE)).cast("int"))
    person, day = F.when(sound, F.col("id_participacion")), F.when(sound, F.col("fecha_ocurrencia"))
    keyed = judged.withWatermark("llegada", "1 second").withColumns({"_persona": person, "_dia": day, "_parte": part})
    return keyed.groupBy("_persona", "_dia", "_parte").applyInPandasWithState(
        _take, OUT, "habitos array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def start_stateful_intake(
    t: Tables, rows: DataFrame, out: str, checkpoint: str, arrival: Column | None = None, grace: int = GRACE, once: bool = False,
) -> StreamingQuery:
    """Starts the intake of a stream of habit rows into ``out``. ``checkpoint`` is a folder every executor can reach.

    ``arrival`` is the time of a row's arrival, by default the time of its batch; a column of the rows may be named instead if it never falls from one
    batch to the next (rows that come after the watermark would be dropped). With ``once`` the query takes what is there and stops.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        found = batch.withColumn("lote", F.lit(batch_id).cast("long")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sound = F.size("motivos") == 0
            _store(found.filter(~sound), f"{out}/{REJECTED}", "lote")
            _store(found.filter(sound).drop("motivos"), f"{out}/{ACCEPTED}", "fecha_ocurrencia", "lote")
        finally:
            found.unpersist()

    stream = taken(judged_on_arrival(t, rows, F.current_timestamp() if arrival is None else arrival, grace))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
