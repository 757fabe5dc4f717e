"""Report tables of a challenge and of a challenger, for all of them at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.functions.text import DAY_FORMAT, activity_label, challenge_name, rating_word, sentence_case
from tablero.operators.spread import FEW_SLOTS, spread_join
from tablero.plans.scoring import habit_counts, scoreboard
from tablero.plans.views import _only
from tablero.schema import CHALLENGE_DAYS
from tablero.sources.tables import Tables

PERSON = ["nombre_reto", "nombre_retador"]


def _spread(df: DataFrame, keys: list[str], by: str, names: Sequence[str], value: str, rows: str) -> DataFrame:
    """Long to wide over the given names; one value per cell, null where there is none. ``otros`` counts the log rows
    (column ``rows``) of all other names."""
    other = F.sum(F.when(~F.col(by).isin(list(names)), F.col(rows)))
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(by) == name, F.col(value))).alias(name) for name in names], F.coalesce(other, F.lit(0)).alias("otros"))


def pivot_habit_counts(t: Tables, names: Sequence[str], *, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Logged days per challenger, one column per given habit and one for the rows of all others; ``habit_counts`` is the long form."""
    return _spread(habit_counts(t, reto=reto, retador=retador), PERSON, "nombre_habito", names, "n", "n")


def habit_days(t: Tables, *, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Who registered each habit on each day, with how many rows. The log is reduced before it meets coaches and people."""
    users = t.coaches.select("nombre_coach", "user_coach")
    people = _only(t.participacion, reto, retador).select("id_participacion", *PERSON)
    logged = t.registros_habitos
    if reto is not None or retador is not None:
        logged = logged.join(people.select("id_participacion"), "id_participacion", "left_semi")
    reduced = logged.groupBy("id_participacion", F.col("fecha_ocurrencia").alias("fecha"), "nombre_habito", "nombre_coach").agg(
        F.count(F.lit(1)).alias("n"))
    known = spread_join(reduced, users, ["nombre_coach"], ["id_participacion", "fecha", "nombre_habito"])
    return (
        known.join(people, "id_participacion")
        .groupBy(*PERSON, "fecha", "nombre_habito").agg(F.max("user_coach").alias("user_coach"), F.sum("n").alias("n")))


def pivot_habit_days(t: Tables, names: Sequence[str], *, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """Who registered each habit on each day, one column per given habit and one for the rows of all others."""
    return _spread(habit_days(t, reto=reto, retador=retador), [*PERSON, "fecha"], "nombre_habito", names, "user_coach", "n")


def attendance_rows(t: Tables, *, reto: str | None = None, retador: str | None = None) -> DataFrame:
    """The rows of :func:`attendance_report` with the start of the activity."""
    held = t.actividades.select("id_actividad", "actividad", "inicio")
    people = _only(t.participacion, reto, retador).select("id_participacion", *PERSON)
    attended = t.registros_actividades.select("id_participacion", "id_actividad", "nombre_coach").join(people, "id_participacion")
    return (
        spread_join(attended, held, ["id_actividad"], ["id_participacion"], "left", FEW_SLOTS)
        .select("nombre_reto", activity_label(F.col("actividad"), F.col("inicio")).alias("actividad"),
                F.col("nombre_retador").alias("retador"), F.col("nombre_coach").alias("registrador"), "inicio"))


def attendance_report(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                      retador: str | None = None) -> DataFrame:
    """Attendance with activity label and registering coach; activities no longer known still show."""
    return attendance_rows(t, reto=reto, retador=retador).drop("inicio")


def ratings_report(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                   retador: str | None = None) -> DataFrame:
    """Ratings in words per challenger, coach and criterion."""
    known = t.retos.select("nombre_reto")
    people = spread_join(_only(t.participacion, reto, retador), known, ["nombre_reto"], ["id_participacion"]).select("id_participacion", *PERSON)
    return (
        t.registros_calificaciones.select("id_participacion", "nombre_coach", "criterio_calificacion", "calificacion")
        .join(people, "id_participacion")
        .select("nombre_reto", F.col("nombre_retador").alias("retador"), F.col("nombre_coach").alias("calificador"),
                F.col("criterio_calificacion").alias("criterio"), rating_word(F.col("calificacion")).alias("calificacion")))


def report_names(t: Tables, *, as_of: date | None = None, reto: str | None = None, retador: str | None = None,
                 dias: int = CHALLENGE_DAYS) -> DataFrame:
    """File names of the detailed reports, dated by the first day written in the challenge's name."""
    names = t.retos.select("nombre_reto", challenge_name(F.col("fecha_ini"), dias).alias("_nombre"))
    day = F.to_date(F.regexp_extract("_nombre", r"del\s(\d{2}/\d{2}/\d{4})", 1), DAY_FORMAT)
    stem = F.concat(F.lit("detalle_reto_"), F.date_format(day, "yyyy-MM-dd"))
    return (
        spread_join(_only(t.participacion, reto, retador), names, ["nombre_reto"], ["id_participacion"])
        .select(F.col("_nombre").alias("nombre_reto"), "nombre_retador",
                F.concat(stem, F.lit(".html")).alias("archivo_reto"),
                F.concat(stem, F.lit("_"), F.regexp_replace("nombre_retador", r"\s", "_"), F.lit(".html")).alias("archivo_retador")))


def scoreboard_report(t: Tables, *, as_of: date | None = None, reto: str | None = None,
                      retador: str | None = None) -> DataFrame:
    """The scoreboard under its printed headings, by challenger and component."""
    rows = scoreboard(t, reto=reto, retador=retador).withColumnRenamed("nombre_retador", "retador")
    return sentence_case(rows.withColumnRenamed("nombre_reto", "reto")).orderBy("Reto", "Retador", "Concepto")


REPORTS = {
    "puntajes": scoreboard,
    "cuenta_habitos": habit_counts,
    "habitos_por_dia": habit_days,
    "asistencia": attendance_report,
    "calificaciones": ratings_report,
}


def write_reports(t: Tables, path: str, *, reto: str | None = None, retador: str | None = None,
                  max_records_per_file: int = 5_000_000, parts: int = 8) -> dict[str, str]:
    """Write each report table under ``path``, one folder per challenge; the habit tables in their long form, so that any
    number of habits fits.

    Rows are dealt by challenge and one of ``parts`` parts before they are written: a challenge has at most that many files (more
    only beyond the records per file), and a large one is shared by as many tasks.
    """
    places = {}
    for name, build in REPORTS.items():
        places[name] = f"{path.rstrip('/')}/{name}"
        rows = build(t, reto=reto, retador=retador)
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
        (rows.repartition("nombre_reto", part).write.mode("errorifexists")
         .option("maxRecordsPerFile", max_records_per_file).partitionBy("nombre_reto").parquet(places[name]))
    return places
