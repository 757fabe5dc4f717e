"""Weighted scores of challengers: per component, per challenge and per day.

All scores share one shape. Each log row is worth a whole number (its weight has two decimals, so it is counted in hundredths),
so sums are exact integers. The three logs are brought to one row per participation in a
single aggregation, which shrinks them on the map side before anything is shuffled, and only then joined with the
participations. The division into points happens once, at the end, in double precision.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablero.functions.dates import last_day
from tablero.operators.running import value_ranks
from tablero.operators.spread import spread_join
from tablero.schema import ACTIVITIES, CEREMONY, CHALLENGE_DAYS, HABITS, INACTIVE, RATING_SCALE, RATINGS
from tablero.sources.tables import Tables

PERSON = ["nombre_reto", "nombre_retador"]
COMPONENTS = {ACTIVITIES: "_actividades", HABITS: "_habitos", RATINGS: "_calificacion"}
DECIMALS = 6
RANK_STEP = 10_000  # a hundredth of a point in units of the last decimal


def participants(t: Tables, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Participations, of one challenge and/or challenger when asked."""
    p = t.participacion.select("id_participacion", *PERSON)
    if reto is not None:
        p = p.filter(F.col("nombre_reto") == reto)
    if retador is not None:
        p = p.filter(F.col("nombre_retador") == retador)
    return p


def logs_of(t: Tables, log: str, component: str, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Rows of a log table. With a filter, those of other participations go before they are aggregated."""
    rows = t[log].filter(F.col("concepto") == component)
    if reto is None and retador is None:
        return rows
    return rows.join(participants(t, reto, retador).select("id_participacion"), "id_participacion", "left_semi")


def active_coach_count(t: Tables) -> Column:
    """Number of coaches who may rate, as a scalar subquery."""
    return t.coaches.filter(F.col("permiso") != INACTIVE).agg(F.count("nombre_coach")).scalar()


def scored_activities(t: Tables, reto: str | None = None) -> DataFrame:
    """Activities per challenge that count towards the score."""
    rows = t.actividades.filter(F.col("actividad") != CEREMONY)
    if reto is not None:
        rows = rows.filter(F.col("nombre_reto") == reto)
    return rows.groupBy("nombre_reto").agg(F.count("id_actividad").alias("_total"))


def _hundredths(weight: str) -> Column:
    return (F.col(weight) * 100).cast("long")


def _component_weight(t: Tables, component: str) -> Column:
    """Weight of a component as a scalar subquery; null, and so no points, if the component is not in use."""
    return t.conceptos.filter(F.col("concepto") == component).agg(F.max("peso_concepto").cast("double")).scalar()


def _worth(t: Tables, component: str, reto: str | None, retador: str | None) -> DataFrame:
    """Log rows of a component with their worth in ``_valor``: hundredths for weighted rows, a count for activities."""
    if component == HABITS:
        weights = t.habitos.select("nombre_habito", _hundredths("peso_habito").alias("_valor"))
        return logs_of(t, "registros_habitos", component, reto, retador).join(weights, "nombre_habito")
    if component == RATINGS:
        weights = t.criterios_calificacion.select("criterio_calificacion", _hundredths("peso_criterio").alias("_p"))
        rows = logs_of(t, "registros_calificaciones", component, reto, retador).join(weights, "criterio_calificacion")
        return rows.withColumn("_valor", F.col("calificacion") * F.col("_p"))
    return logs_of(t, "registros_actividades", component, reto, retador).withColumn("_valor", F.lit(1).cast("long"))


def component_worth(t: Tables, component: str) -> DataFrame:
    """Rows of a component's log, with any further columns, and their worth in ``_valor``."""
    return _worth(t, component, None, None)


def _sums(t: Tables, components: list[str], reto: str | None, retador: str | None) -> DataFrame:
    """One row per challenger of a challenge and one worth column per component, null where nothing was logged."""
    parts = []
    for component in components:
        worth = _worth(t, component, reto, retador)
        parts.append(worth.select("id_participacion", *[
            (F.col("_valor") if c == component else F.lit(None).cast("long")).alias(COMPONENTS[c]) for c in components]))
    logs = parts[0]
    for part in parts[1:]:
        logs = logs.unionByName(part)
    cols = [COMPONENTS[c] for c in components]
    return _by_person(t, logs.groupBy("id_participacion").agg(*[F.sum(c).alias(c) for c in cols]), cols, reto, retador)


def _by_person(t: Tables, per_participation: DataFrame, cols: list[str], reto: str | None, retador: str | None) -> DataFrame:
    named = per_participation.join(participants(t, reto, retador), "id_participacion")
    return named.groupBy(*PERSON).agg(*[F.sum(c).alias(c) for c in cols])


def _habit_points(t: Tables, worth: Column, dias: int) -> Column:
    return worth.cast("double") / dias * _component_weight(t, HABITS)


def _points(t: Tables, component: str, dias: int, escala: int) -> Column:
    """Points of a component from its worth; needs ``_total`` for the activities."""
    worth = F.col(COMPONENTS[component])
    if component == HABITS:
        return _habit_points(t, worth, dias)
    if component == RATINGS:
        mean = F.try_divide(worth.cast("double"), active_coach_count(t).cast("double"))
        return mean / escala * _component_weight(t, RATINGS)
    return worth.cast("double") / F.col("_total") * _component_weight(t, ACTIVITIES) * 100.0


def _wide_points(
    t: Tables, components: list[str], reto: str | None, retador: str | None, dias: int, escala: int, earned: DataFrame | None = None
) -> DataFrame:
    """Unclamped points in one column per component; null where the component does not apply. ``earned`` has the worths per participation
    where they are known already."""
    known = earned is not None
    sums = _by_person(t, earned, [COMPONENTS[c] for c in components], reto, retador) if known else _sums(t, components, reto, retador)
    if ACTIVITIES in components:
        sums = spread_join(sums, scored_activities(t, reto), ["nombre_reto"], ["nombre_retador"], "left")
    return sums.select(*PERSON, *[_points(t, c, dias, escala).alias(COMPONENTS[c]) for c in components])


def clamp(points: Column) -> Column:
    """Points below zero count as zero; null stays null."""
    return F.when(points < 0, 0.0).otherwise(points)


def _rounded(points: Column) -> Column:
    return F.round(points, DECIMALS)


def _component(t: Tables, component: str, reto: str | None, retador: str | None, dias: int, escala: int) -> DataFrame:
    points = F.col(COMPONENTS[component])
    return (
        _wide_points(t, [component], reto, retador, dias, escala).filter(points.isNotNull())
        .select(*PERSON, F.lit(component).alias("concepto"), _rounded(points).alias("puntaje")))


def score_habits(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
                 dias: int = CHALLENGE_DAYS) -> DataFrame:
    """Habit points: weights of all logged habits over the days of a challenge."""
    return _component(t, HABITS, reto, retador, dias, RATING_SCALE)


def score_activities(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                     retador: str | None = None) -> DataFrame:
    """Activity points: attended over scored activities. Ceremonies are left out of the divisor only."""
    return _component(t, ACTIVITIES, reto, retador, CHALLENGE_DAYS, RATING_SCALE)


def score_ratings(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
                  escala: int = RATING_SCALE) -> DataFrame:
    """Rating points: mean over all active coaches, of whom those who did not rate count as zero."""
    return _component(t, RATINGS, reto, retador, CHALLENGE_DAYS, escala)


def habit_counts(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Logged days per challenge, challenger and habit."""
    per_participation = (
        logs_of(t, "registros_habitos", HABITS, reto, retador)
        .groupBy("id_participacion", "nombre_habito").agg(F.count("nombre_habito").alias("n")))
    return (
        per_participation.join(participants(t, reto, retador), "id_participacion")
        .groupBy(*PERSON, "nombre_habito").agg(F.sum("n").alias("n")))


def rating_means(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Mean rating per criterion over all active coaches."""
    per_participation = (
        logs_of(t, "registros_calificaciones", RATINGS, reto, retador)
        .groupBy("id_participacion", "criterio_calificacion").agg(F.sum("calificacion").alias("_suma")))
    mean = F.try_divide(F.col("_suma").cast("double"), active_coach_count(t).cast("double"))
    return (
        per_participation.join(participants(t, reto, retador), "id_participacion")
        .groupBy(*PERSON, "criterio_calificacion").agg(F.sum("_suma").alias("_suma"))
        .select(*PERSON, "criterio_calificacion", _rounded(mean).alias("prom")))


def _scored(t: Tables, reto: str | None, retador: str | None, dias: int, escala: int, earned: DataFrame | None = None) -> DataFrame:
    """Clamped points per component and their total, one row per challenger of a challenge."""
    wide = _wide_points(t, list(COMPONENTS), reto, retador, dias, escala, earned)
    clamped = wide.select(*PERSON, *[clamp(F.col(c)).alias(c) for c in COMPONENTS.values()])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS.values()), F.lit(0.0))
    return clamped.filter(F.coalesce(*COMPONENTS.values()).isNotNull()).withColumn("total", _rounded(total))


def scoreboard(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
               dias: int = CHALLENGE_DAYS, escala: int = RATING_SCALE, earned: DataFrame | None = None) -> DataFrame:
    """One row per challenger and component with its points, none below zero, and the challenger's total. ``earned`` (id_participacion and a worth
    per component) stands for the logs where :mod:`tablero.plans.upkeep` keeps their sums."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("concepto"), _rounded(F.col(c)).alias("puntaje")) for name, c in COMPONENTS.items()])
    return (
        _scored(t, reto, retador, dias, escala, earned).select(*PERSON, "total", F.inline(rows))
        .filter(F.col("puntaje").isNotNull()).select(*PERSON, "concepto", "puntaje", "total"))


def rank_totals(totals: DataFrame) -> DataFrame:
    """Place of each challenger of a challenge by ``total``, ties sharing a place.

    Totals carry six decimals, so a bucket of a hundredth of a point holds at most ``RANK_STEP`` different ones, however many
    challengers a challenge has.
    """
    whole = totals.withColumn("_v", F.round(F.col("total") * 10**DECIMALS).cast("long"))
    places = value_ranks(whole, ["nombre_reto"], "_v", RANK_STEP, descending=True)
    # One row per total against all that have it: where many do, Spark divides them as measured.
    return whole.join(places, ["nombre_reto", "_v"]).select(*PERSON, "total", "puesto")


def ranking(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
            dias: int = CHALLENGE_DAYS, escala: int = RATING_SCALE) -> DataFrame:
    """Places in each challenge by total. A filter on the challenger picks from the full ranking.

    Where the scoreboard is stored, :func:`rank_totals` over the stored totals saves computing them again.
    """
    places = rank_totals(_scored(t, reto, None, dias, escala).select(*PERSON, "total"))
    return places if retador is None else places.filter(F.col("nombre_retador") == retador)


def _daily(rows: DataFrame) -> DataFrame:
    return rows.select(*PERSON, "concepto", "fecha_ocurrencia", _rounded(F.col("puntaje")).alias("puntaje"))


def _habit_days(t: Tables, reto: str | None, retador: str | None, dias: int) -> DataFrame:
    per_participation = (
        _worth(t, HABITS, reto, retador).groupBy("id_participacion", "fecha_ocurrencia").agg(F.sum("_valor").alias("_valor")))
    return (
        per_participation.join(participants(t, reto, retador), "id_participacion")
        .groupBy(*PERSON, "fecha_ocurrencia").agg(F.sum("_valor").alias("_valor"))
        .select(*PERSON, F.lit(HABITS).alias("concepto"), "fecha_ocurrencia",
                _habit_points(t, F.col("_valor"), dias).alias("puntaje")))


def _activity_days(t: Tables, reto: str | None, retador: str | None) -> DataFrame:
    slots = t.actividades.select("id_actividad", "inicio", "fin")
    reduced = (
        logs_of(t, "registros_actividades", ACTIVITIES, reto, retador)
        .groupBy("id_participacion", "id_actividad").agg(F.count(F.lit(1)).alias("_n")))
    per_participation = (
        reduced.join(slots, "id_actividad")
        .groupBy("id_participacion", "inicio", "fin").agg(F.sum("_n").alias("_n")))
    per_slot = (
        per_participation.join(participants(t, reto, retador), "id_participacion")
        .groupBy(*PERSON, "inicio", "fin").agg(F.sum("_n").alias("_n")))
    share = F.col("_n") / (F.col("_n") * F.col("_total"))
    return (
        spread_join(per_slot, scored_activities(t, reto), ["nombre_reto"], ["nombre_retador"])
        .select(*PERSON, F.lit(ACTIVITIES).alias("concepto"), F.to_date("fin").alias("fecha_ocurrencia"),
                (share * _component_weight(t, ACTIVITIES) * 100.0).alias("puntaje")))


def _rating_days(t: Tables, reto: str | None, retador: str | None, escala: int) -> DataFrame:
    days = t.retos.select("nombre_reto", last_day(F.col("fecha_fin_excl")).alias("fecha_ocurrencia"))
    points = F.col(COMPONENTS[RATINGS])
    rated = _wide_points(t, [RATINGS], reto, retador, CHALLENGE_DAYS, escala).filter(points.isNotNull())
    return (
        spread_join(rated, days, ["nombre_reto"], ["nombre_retador"])
        .select(*PERSON, F.lit(RATINGS).alias("concepto"), "fecha_ocurrencia", points.alias("puntaje")))


def daily_habits(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
                 dias: int = CHALLENGE_DAYS) -> DataFrame:
    """Habit points on the day they were earned."""
    return _daily(_habit_days(t, reto, retador, dias))


def daily_activities(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                     retador: str | None = None) -> DataFrame:
    """Activity points per time slot attended, dated on the day the slot ends. A slot counts once."""
    return _daily(_activity_days(t, reto, retador))


def daily_ratings(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
                  escala: int = RATING_SCALE) -> DataFrame:
    """Rating points, dated on the last day of the challenge."""
    return _daily(_rating_days(t, reto, retador, escala))


def daily_scoreboard(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
                     dias: int = CHALLENGE_DAYS, escala: int = RATING_SCALE) -> DataFrame:
    """All points by day, none below zero, with the total of the challenger's day."""
    rows = (
        _habit_days(t, reto, retador, dias)
        .unionByName(_activity_days(t, reto, retador))
        .unionByName(_rating_days(t, reto, retador, escala))
        .withColumn("puntaje", clamp(F.col("puntaje"))))
    day = Window.partitionBy(*PERSON, "fecha_ocurrencia")
    total = F.coalesce(F.sum("puntaje").over(day), F.lit(0.0))
    return rows.select(
        *PERSON, "concepto", "fecha_ocurrencia", _rounded(F.col("puntaje")).alias("puntaje"), _rounded(total).alias("total"))
