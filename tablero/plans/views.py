"""Listings, lookups, dense entry grids and derived measurements."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.functions.dates import age_parts, age_text, last_day, minutes_between
from tablero.functions.text import (
    CLOCK_FORMAT,
    activity_label,
    challenge_name,
    percent_text,
    rating_code,
    rating_word,
)
from tablero.operators.catalogue import per_catalogue_row
from tablero.operators.spread import spread_join
from tablero.schema import ADMIN, CEREMONY, CHALLENGE_DAYS, ENUM_COLUMNS, ENUMS, INACTIVE
from tablero.sources.tables import Tables

LOG_COLUMNS = ["id_participacion", "concepto", "nombre_coach", "fecha_registro"]


def _only(df: DataFrame, reto: str | None, retador: str | None = None) -> DataFrame:
    if reto is not None:
        df = df.filter(F.col("nombre_reto") == reto)
    if retador is not None:
        df = df.filter(F.col("nombre_retador") == retador)
    return df


def scan_coaches(t: Tables) -> DataFrame:
    """All coaches by name."""
    return t.coaches.orderBy(F.col("nombre_coach").asc_nulls_last())


def active_coaches(t: Tables) -> DataFrame:
    """Coaches who may expose, rate and log in."""
    return t.coaches.filter(F.col("permiso") != INACTIVE).select("id_coach", "nombre_coach")


def challenges(t: Tables, *, reto: str | None = None) -> DataFrame:
    """Challenges with their first and last day, newest first. The two days also bound what may be logged."""
    rows = _only(t.retos, reto).select(
        "id_reto", "nombre_reto", F.col("fecha_ini").alias("fecha_inicio"),
        last_day(F.col("fecha_fin_excl")).alias("fecha_fin"), "reto_activo")
    return rows.orderBy(F.col("fecha_inicio").desc_nulls_first())


def active_challenges(t: Tables, *, reto: str | None = None) -> DataFrame:
    return challenges(t, reto=reto).filter("reto_activo")


def challenge_names(t: Tables, *, reto: str | None = None, dias: int = CHALLENGE_DAYS) -> DataFrame:
    """The name each challenge would get from its first day."""
    return _only(t.retos, reto).select("id_reto", challenge_name(F.col("fecha_ini"), dias).alias("nombre"))


def all_logs(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """The columns the three log tables share."""
    habits, attended, ratings = (
        t[name].select(*LOG_COLUMNS)
        for name in ("registros_habitos", "registros_actividades", "registros_calificaciones"))
    rows = habits.unionByName(attended).unionByName(ratings)
    if reto is None and retador is None:
        return rows
    return rows.join(_only(t.participacion, reto, retador).select("id_participacion"), "id_participacion", "left_semi")


def domain_values(t: Tables) -> DataFrame:
    """Every label of each enumerated column, in its declared order, with how often it is used; also values in use that are no label."""
    used = reduce(DataFrame.unionByName, [
        t[table].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("usos"))
        .select(F.lit(domain).alias("variable"), "valor", "usos")
        for table, column, domain in ENUM_COLUMNS])
    labels = [(domain, label, place) for domain, values in ENUMS.items() for place, label in enumerate(values, 1)]
    declared = t.spark.createDataFrame(labels, "variable string, valor string, orden int")
    return used.groupBy("variable", "valor").agg(F.sum("usos").alias("usos")).join(declared, ["variable", "valor"], "full").select(
        "variable", "valor", "orden", F.coalesce("usos", F.lit(0)).cast("long").alias("usos")).orderBy("variable", F.col("orden").asc_nulls_last(), "valor")


def participation_lookup(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                         retador: str | None = None) -> DataFrame:
    """Participation id, height, coach and objective by challenge and challenger."""
    people = t.retadores.select("nombre_retador", F.col("talla").cast("double").alias("talla"), "nombre_coach")
    return (
        _only(t.participacion, reto, retador).join(people, "nombre_retador")
        .select("id_participacion", "nombre_reto", "nombre_retador", "talla", "nombre_coach", "objetivo_participacion"))


def roster(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Enrolled challengers with coach, phone and a display label."""
    people = t.retadores.select("nombre_retador", "nombre_coach", "num_celular_retador")
    label = F.concat_ws(" - ", "nombre_retador", F.coalesce("num_celular_retador", F.lit("NA")))
    return (
        _only(t.participacion, reto, retador).join(people, "nombre_retador")
        .select("id_participacion", "nombre_reto", "nombre_retador", "objetivo_participacion", "nombre_coach",
                "num_celular_retador", label.alias("lista")))


def roster_visible(t: Tables, *, me: str, role: str, as_of: date | None = None, reto: str | None = None,
                   retador: str | None = None) -> DataFrame:
    """The roster a user may see: administrators all of it, others their own challengers."""
    rows = roster(t, reto=reto, retador=retador)
    return rows if role == ADMIN else rows.filter(F.col("nombre_coach") == me)


def activities(t: Tables, *, reto: str | None = None) -> DataFrame:
    """Activities with duration in minutes and printed times, latest first."""
    rows = _only(t.actividades, reto).select(
        "id_actividad", "nombre_reto", "actividad", "inicio", "fin",
        minutes_between(F.col("inicio"), F.col("fin")).alias("duracion"), "tema_actividad", "coach_expositor",
        F.date_format("inicio", CLOCK_FORMAT).alias("inicio_mostrar"), F.date_format("fin", CLOCK_FORMAT).alias("fin_mostrar"))
    return rows.orderBy(F.col("inicio").desc_nulls_first())


def activity_labels(t: Tables, *, reto: str | None = None) -> DataFrame:
    """Labels of the activities that can be attended for points."""
    return _only(t.actividades, reto).filter(F.col("actividad") != CEREMONY).select(
        "id_actividad", "nombre_reto", activity_label(F.col("actividad"), F.col("inicio")).alias("etiqueta"))


def rating_labels(df: DataFrame) -> DataFrame:
    """Ratings as words."""
    return df.select("id_participacion", "criterio_calificacion", "nombre_coach",
                     rating_word(F.col("calificacion")).alias("calificacion"))


def rating_codes(df: DataFrame) -> DataFrame:
    """Rating words as numbers."""
    return df.select("id_participacion", "criterio_calificacion", "nombre_coach",
                     rating_code(F.col("calificacion")).alias("calificacion"))


def measurements_dense(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                       retador: str | None = None) -> DataFrame:
    """Every parameter for every participation, with its values where measured."""
    return _measured(t, _only(t.participacion, reto, retador).select("id_participacion"))


def _measured(t: Tables, people: DataFrame) -> DataFrame:
    """The grid of people (with whatever columns they bring) and parameters."""
    logged = t.registros_parametros.select("id_participacion", "nombre_parametro", "valor_inicial", "valor_final")
    catalogue = t.parametros.select("nombre_parametro", "unidad")
    return (
        per_catalogue_row(people, catalogue).join(logged, ["id_participacion", "nombre_parametro"], "left")
        .select(*people.columns, F.col("nombre_parametro").alias("parametro"), F.col("valor_inicial").alias("inicial"),
                F.col("valor_final").alias("final"), F.col("unidad").alias("und")))


def measurement_deltas(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                       retador: str | None = None) -> DataFrame:
    """Measurements with their change, and a body-mass-index row for each weight row."""
    heights = participation_lookup(t, reto=reto, retador=retador).select(
        "id_participacion", F.col("talla").alias("_talla"))
    rows = _measured(t, heights)
    square = F.col("_talla") * F.col("_talla")
    own = F.struct("parametro", "inicial", "final", "und")
    index = F.struct(
        F.lit("IMC").alias("parametro"), F.round(F.col("inicial") / square, 2).alias("inicial"),
        F.round(F.col("final") / square, 2).alias("final"), F.lit("").alias("und"))
    lines = F.when(F.col("parametro") == "Peso", F.array(index, own)).otherwise(F.array(own))
    change = F.col("final") - F.col("inicial")
    ratio = F.try_divide(change, F.col("inicial"))
    return (
        rows.select("id_participacion", F.inline(lines))
        .select("id_participacion", "parametro", "inicial", "final", F.round(change, 6).alias("variacion"),
                F.round(ratio, 6).alias("var_pct"), percent_text(ratio).alias("var_pct_text"), "und"))


def challenger_age(t: Tables, *, as_of: date, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Age in years, months and days, and in words; of those enrolled in a challenge when asked."""
    people = _only(t.retadores, None, retador)
    if reto is not None:
        people = people.join(_only(t.participacion, reto).select("nombre_retador"), "nombre_retador", "left_semi")
    years, months, days = age_parts(F.col("fecha_nacimiento"), as_of)
    parts = people.select(
        "id_retador", years.cast("int").alias("anios"), months.cast("int").alias("meses"), days.cast("int").alias("dias"))
    return parts.withColumn("edad", age_text(F.col("anios"), F.col("meses"), F.col("dias")))


def habit_checklist(t: Tables, *, as_of: date | None = None, fecha: date | None = None, reto: str | None = None,
                    retador: str | None = None) -> DataFrame:
    """Every habit on every day of a participation, whether logged and by whom."""
    spans = t.retos.select("nombre_reto", "fecha_ini", last_day(F.col("fecha_fin_excl")).alias("_ultima"))
    logged = t.registros_habitos
    if reto is not None or retador is not None:
        logged = logged.join(_only(t.participacion, reto, retador).select("id_participacion"), "id_participacion", "left_semi")
    if fecha is not None:
        logged = logged.filter(F.col("fecha_ocurrencia") == fecha)
    logged = logged.groupBy(
        "id_participacion", F.col("fecha_ocurrencia").alias("fecha"), "nombre_habito", "nombre_coach",
    ).agg(F.count("id_registro_habito").alias("_n"))
    people = _only(t.participacion, reto, retador).select("id_participacion", "nombre_reto")
    # The days unfold beside the participations: the side that is repeated and perhaps broadcast has one row per challenge.
    dated = spread_join(people, spans, ["nombre_reto"], ["id_participacion"]).select("id_participacion", F.explode(F.sequence("fecha_ini", "_ultima")).alias("fecha"))
    if fecha is not None:
        dated = dated.filter(F.col("fecha") == fecha)
    grid = per_catalogue_row(dated, t.habitos.select("nombre_habito"))
    return (
        grid.join(logged, ["id_participacion", "fecha", "nombre_habito"], "left")
        .select("id_participacion", "fecha", "nombre_habito", (F.coalesce("_n", F.lit(0)) != 0).alias("registro"), "nombre_coach"))


def attendance_checklist(t: Tables, *, actividades: int | DataFrame, retador: str | None = None) -> DataFrame:
    """The roster of the challenge of an activity, whether attended and registered by whom; for one id or a table of ids."""
    held, logged = t.actividades.select("id_actividad", "nombre_reto"), t.registros_actividades
    if isinstance(actividades, DataFrame):
        wanted = actividades.select("id_actividad").distinct()
        held, logged = (df.join(wanted, "id_actividad", "left_semi") for df in (held, logged))
    else:
        held, logged = (df.filter(F.col("id_actividad") == actividades) for df in (held, logged))
    logged = logged.groupBy("id_actividad", "id_participacion", "nombre_coach").agg(
        F.count("id_registro_actividad").alias("_n"))
    people = _only(t.participacion, None, retador).select("id_participacion", "nombre_retador", "nombre_reto")
    return (
        spread_join(people, held, ["nombre_reto"], ["id_participacion"]).join(logged, ["id_actividad", "id_participacion"], "left")
        .select("id_actividad", "id_participacion", "nombre_retador", (F.coalesce("_n", F.lit(0)) != 0).alias("registro"),
                "nombre_coach"))


def ratings_dense(t: Tables, *, coach: str, as_of: date | None = None, reto: str | None = None,
                  retador: str | None = None) -> DataFrame:
    """Every criterion for every participation with the word one coach gave, null where not rated."""
    logged = t.registros_calificaciones.filter(F.col("nombre_coach") == coach).select(
        "id_participacion", "criterio_calificacion", rating_word(F.col("calificacion")).alias("calificacion"))
    people = _only(t.participacion, reto, retador).select("id_participacion")
    grid = per_catalogue_row(people, t.criterios_calificacion.select("criterio_calificacion"))
    return grid.join(logged, ["id_participacion", "criterio_calificacion"], "left")
