"""Scores and indicators kept up to date from changes, without counting the logs again.

What a participation has earned is a row of whole numbers: per component the worth of its log rows and their number. Both add up, so a change of
the logs is a row of signed numbers per touched participation: what its rows are worth afterwards less what they were worth before. Added to the
stored numbers it gives those of the changed logs, exactly. Weights are part of the numbers: with other weights they are counted anew.

A save looks only at the rows that its batch may change (:func:`touched`): they are read from the log once and written to the session's shared
folder, and the rules of :mod:`tablero.plans.saving` run over them alone, since no rule of a log looks at rows of another key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.operators.stored import fits, stored, weighed
from tablero.plans import kpi
from tablero.plans.saving import Saved
from tablero.plans.scoring import COMPONENTS, PERSON, component_worth, scoreboard
from tablero.schema import ACTIVITIES, CHALLENGE_DAYS, HABITS, RATING_SCALE, RATINGS
from tablero.sources.tables import Tables

LOGS = {"registros_actividades": ACTIVITIES, "registros_habitos": HABITS, "registros_calificaciones": RATINGS}
#: What a row of a batch and the log rows that saving it may change have in common: a blank rating removes all of its coach for the participation.
TOUCHES = {
    "registros_actividades": ["id_participacion", "id_actividad"], "registros_habitos": ["id_participacion", "fecha_ocurrencia", "nombre_habito"],
    "registros_calificaciones": ["id_participacion", "nombre_coach"]}
#: The column of these that tells few people's entries from all others: where a batch has few of its values, they leave out other rows before the log is moved.
NARROWS = {"registros_calificaciones": "nombre_coach"}
#: Columns of the stored numbers: worth and number of rows per component.
WORTHS = list(COMPONENTS.values())
COUNTS = {c: f"_n{name}" for c, name in COMPONENTS.items()}
NUMBERS = [*WORTHS, *COUNTS.values()]


def _numbers(t: Tables, logs: Iterable[str]) -> DataFrame:
    """One row per participation: the signed worth (``_signo``) and number of the rows of the given logs."""
    parts = []
    for component in (LOGS[log] for log in logs):
        own = {COMPONENTS[component]: F.col("_valor") * F.col("_signo"), COUNTS[component]: F.when(F.col("_valor").isNotNull(), F.col("_signo"))}
        none = F.lit(None).cast("long")
        parts.append(component_worth(t, component).select("id_participacion", *[own.get(c, none).cast("long").alias(c) for c in NUMBERS]))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("id_participacion").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NUMBERS])


def worths(t: Tables) -> DataFrame:
    """The numbers of all participations with log rows, to be stored."""
    return _numbers(t.replace(**{log: t[log].withColumn("_signo", F.lit(1)) for log in LOGS}), LOGS)


def touched(t: Tables, log: str, batch: DataFrame) -> DataFrame:
    """The rows of a log that saving a batch may change, written once."""
    key, rows = TOUCHES[log], t[log]
    if log in NARROWS:
        few = stored(batch.select(NARROWS[log]).distinct())
        rows = rows.join(few, NARROWS[log], "left_semi") if fits(few) else rows
    return weighed(stored(rows.join(batch.select(*key), key, "left_semi").select(*t[log].columns), "zstd"))


def deltas(t: Tables, changes: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Signed numbers per participation from (rows before, rows after) of each changed log. Rows that stay cancel out, so both may be any part of
    the log that holds all changed rows."""
    signed = {
        log: before.withColumn("_signo", F.lit(-1)).unionByName(after.withColumn("_signo", F.lit(1))) for log, (before, after) in changes.items()}
    rows = _numbers(t.replace(**signed), signed)
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in NUMBERS]))


def saved_deltas(t: Tables, saves: dict[str, tuple[DataFrame, Callable[[Tables, DataFrame], Saved]]]) -> DataFrame:
    """Signed numbers of saving a batch into each named log under its rules; ``saves`` gives per log the batch and the function of
    :mod:`tablero.plans.saving` that judges and applies it. Batches, which a save reads several times, and the result are written once."""
    changes = {}
    for log, (rows, save) in saves.items():
        batch = weighed(stored(rows, "zstd"))
        before = touched(t, log, batch)
        changes[log] = (before, save(t.replace(**{log: before}), batch).table)
    return weighed(stored(deltas(t, changes)))


def updated(numbers: DataFrame, change: DataFrame) -> DataFrame:
    """The stored numbers after a change. Participations without any rows left are gone."""
    rows = numbers.unionByName(change).groupBy("id_participacion").agg(*[F.sum(c).alias(c) for c in NUMBERS])
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in COUNTS.values()]))


def _earned(numbers: DataFrame) -> DataFrame:
    """Worth per component as the scores expect it: null where there are no rows."""
    return numbers.select("id_participacion", *[F.when(F.col(COUNTS[c]) > 0, F.col(name)).alias(name) for c, name in COMPONENTS.items()])


def scoreboard_of(t: Tables, numbers: DataFrame, *, dias: int = CHALLENGE_DAYS, escala: int = RATING_SCALE) -> DataFrame:
    """The scoreboard of the participations in ``numbers``; the logs are not read."""
    return scoreboard(t, dias=dias, escala=escala, earned=_earned(numbers))


def refreshed_scoreboard(
    t: Tables, board: DataFrame, numbers: DataFrame, change: DataFrame, *, dias: int = CHALLENGE_DAYS, escala: int = RATING_SCALE
) -> DataFrame:
    """The stored scoreboard after a change; ``numbers`` are those from before it.

    Only rows of touched challengers are computed again; the others pass through. Number of activities and of coaches must be those that the board was made with.
    """
    ids = change.select("id_participacion")
    people = t.participacion.join(ids, "id_participacion", "left_semi").select(*PERSON).distinct()
    again = updated(numbers.join(ids, "id_participacion", "left_semi"), change)
    fresh = scoreboard_of(t, again, dias=dias, escala=escala)
    return board.join(people, PERSON, "left_anti").unionByName(fresh)


def refreshed_kpis(t: Tables, numbers: DataFrame, change: DataFrame, *, as_of: date) -> DataFrame:
    """The participation indicators after a change, from the numbers of rows alone."""
    counted = updated(numbers, change).select(
        "id_participacion", F.nullif(F.col(COUNTS[HABITS]), F.lit(0)).alias("_h"), F.nullif(F.col(COUNTS[ACTIVITIES]), F.lit(0)).alias("_a"))
    return kpi.kpis(t, as_of=as_of, counted=t.participacion.join(counted, "id_participacion", "left"))
