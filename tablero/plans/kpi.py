"""Participation indicators of the active challenges on a given day."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.functions.text import percent_text
from tablero.schema import ACTIVITIES, CEREMONY, HABITS
from tablero.sources.tables import Tables

RATE_DECIMALS = 4


def selected(challenges: DataFrame, ids: Iterable[int] | DataFrame | None) -> DataFrame:
    """Challenges whose id is in a list, or in the column ``id_reto`` of a table for selections of any size."""
    if ids is None:
        return challenges
    if isinstance(ids, DataFrame):
        return challenges.join(ids.select("id_reto"), "id_reto", "left_semi")
    return challenges.filter(F.col("id_reto").isin(list(ids)))


def _active(t: Tables, ids: Iterable[int] | DataFrame | None = None, reto: str | None = None) -> DataFrame:
    rows = t.retos.filter("reto_activo")
    rows = selected(rows, ids)
    if reto is not None:
        rows = rows.filter(F.col("nombre_reto") == reto)
    return rows.select("id_reto", "nombre_reto", "fecha_ini", "fecha_fin_excl")


def _elapsed_days(as_of: date) -> Column:
    """Days of the challenge so far, today included; the full length once it is over."""
    running = F.lit(as_of) < F.col("fecha_fin_excl")
    so_far = F.datediff(F.lit(as_of), F.col("fecha_ini")) + 1
    return F.when(running, so_far).otherwise(F.datediff(F.col("fecha_fin_excl"), F.col("fecha_ini"))).cast("long")


def _per_challenge(t: Tables, active: DataFrame, as_of: date, *aggregates: Column) -> DataFrame:
    """Challengers and elapsed days per active challenge, with further sums over its participations."""
    per_name = t["participacion"].groupBy("nombre_reto").agg(F.count("nombre_retador").alias("num_retadores"), *aggregates)
    return active.join(per_name, "nombre_reto").withColumn("num_dias", _elapsed_days(as_of))


def challenge_progress(t: Tables, *, as_of: date, reto: str | None = None) -> DataFrame:
    """Enrolled challengers and elapsed days of each active challenge."""
    return _per_challenge(t, _active(t, reto=reto), as_of).select("id_reto", "nombre_reto", "num_retadores", "num_dias")


def activities_to_date(t: Tables, as_of: date) -> DataFrame:
    """Scored activities per challenge that have begun by the given day."""
    begun = (F.to_date("inicio") <= F.lit(as_of)) & (F.col("actividad") != CEREMONY)
    return t.actividades.filter(begun).groupBy("nombre_reto").agg(F.count(F.lit(1)).alias("num_actividades"))


def _counted_participations(t: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Participations with the number of their habit and attendance rows, null where there are none.

    ``wanted`` (challenge names) reaches the participations and, through them, the logs before anything is counted.
    """
    none = F.lit(None).cast("long")
    people, logs = t.participacion, {name: t[name] for name in ("registros_habitos", "registros_actividades")}
    if wanted is not None:
        people = people.join(wanted, "nombre_reto", "left_semi")
        logs = {name: df.join(people.select("id_participacion"), "id_participacion", "left_semi") for name, df in logs.items()}
    habits = logs["registros_habitos"].filter(F.col("concepto") == HABITS).select(
        "id_participacion", F.lit(1).cast("long").alias("_h"), none.alias("_a"))
    attended = logs["registros_actividades"].filter(F.col("concepto") == ACTIVITIES).select(
        "id_participacion", none.alias("_h"), F.lit(1).cast("long").alias("_a"))
    counts = habits.unionByName(attended).groupBy("id_participacion").agg(F.sum("_h").alias("_h"), F.sum("_a").alias("_a"))
    return people.join(counts, "id_participacion", "left")


def _rate(logged: Column, expected: Column) -> Column:
    """Share in exact decimals, rounded half up; null without log rows."""
    share = F.try_divide(logged.cast("decimal(18,0)"), expected.cast("decimal(18,0)"))
    return F.round(share, RATE_DECIMALS).cast("double")


def kpis(t: Tables, *, as_of: date, ids: Iterable[int] | DataFrame | None = None, reto: str | None = None,
         counted: DataFrame | None = None) -> DataFrame:
    """Habit fill rate and attendance rate of each active challenge.

    Habits are expected from every challenger on every elapsed day, attendance at every scored activity so far. The two logs are
    counted per participation in one pass before they meet the participations. ``counted`` has the participations with the numbers of their rows
    where those are known already.
    """
    active = _active(t, ids, reto)
    wanted = None if ids is None and reto is None else active.select("nombre_reto")
    people = _counted_participations(t, wanted) if counted is None else counted
    per_challenge = _per_challenge(
        t.replace(participacion=people), active, as_of, F.sum("_h").alias("_h"), F.sum("_a").alias("_a"))
    habits = t.habitos.agg(F.count(F.lit(1))).scalar()
    joined = per_challenge.join(activities_to_date(t, as_of), "nombre_reto", "left")
    return joined.select(
        "id_reto", "nombre_reto", F.col("num_retadores").alias("retadores"),
        _rate(F.col("_h"), F.col("num_retadores") * F.col("num_dias") * habits).alias("habitos"),
        _rate(F.col("_a"), F.col("num_actividades") * F.col("num_retadores")).alias("actividades"))


def kpis_display(t: Tables, *, as_of: date, ids: Iterable[int] | DataFrame | None = None,
                 reto: str | None = None) -> DataFrame:
    """The indicators as shown: rates as percentages, without the id."""
    rows = kpis(t, as_of=as_of, ids=ids, reto=reto)
    return rows.select(
        "nombre_reto", "retadores", percent_text(F.col("habitos")).alias("habitos"),
        percent_text(F.col("actividades")).alias("actividades"))
