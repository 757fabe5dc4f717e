"""Report tables in their printed order, for all challenges at once: each row has its position, whatever files and tasks hold it.

Orders follow the printed reports; nulls come last. A key that is not printed (the number of a habit, the day of an activity) orders and is dropped. The
positions are computed in jobs that run while the functions are called, over ranges of the order (:mod:`tablero.operators.positions`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.operators.positions import positioned, write_in_order
from tablero.plans.reports import PERSON, attendance_rows, habit_days, ratings_report
from tablero.plans.scoring import habit_counts, scoreboard
from tablero.sources.tables import Tables


def _listed(rows: DataFrame, *order: str, hidden: str | None = None) -> DataFrame:
    placed = positioned(rows, [F.col(c).asc_nulls_last() for c in order])
    return placed.drop(hidden) if hidden else placed


def _numbered_habits(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(t.habitos.select("nombre_habito", "id_habito"), "nombre_habito", "left").select(*rows.columns, "id_habito")


def scores_listed(t: Tables) -> DataFrame:
    """The scoreboard by challenge, challenger and component."""
    return _listed(scoreboard(t), *PERSON, "concepto")


def habit_counts_listed(t: Tables) -> DataFrame:
    """Logged days by challenge, challenger and number of the habit."""
    return _listed(_numbered_habits(t, habit_counts(t)), *PERSON, "id_habito", "nombre_habito", hidden="id_habito")


def habit_days_listed(t: Tables) -> DataFrame:
    """Who registered a habit on a day, by challenge, challenger, number of the habit and day."""
    return _listed(_numbered_habits(t, habit_days(t)), *PERSON, "id_habito", "nombre_habito", "fecha", hidden="id_habito")


def attendance_listed(t: Tables) -> DataFrame:
    """Attendance by challenge, day of the activity and challenger, then by activity and coach."""
    rows = attendance_rows(t).withColumn("inicio", F.to_date("inicio"))
    return _listed(rows, "nombre_reto", "inicio", "retador", "actividad", "registrador", hidden="inicio")


def ratings_listed(t: Tables) -> DataFrame:
    """Ratings by challenge, challenger, coach and criterion."""
    return _listed(ratings_report(t), "nombre_reto", "retador", "calificador", "criterio")


LISTINGS: dict[str, Callable[[Tables], DataFrame]] = {
    "puntajes": scores_listed, "cuenta_habitos": habit_counts_listed, "habitos_por_dia": habit_days_listed, "asistencia": attendance_listed,
    "calificaciones": ratings_listed,
}


def write_listings(t: Tables, path: str) -> dict[str, str]:
    """Writes every listing under ``path`` in the order of its positions."""
    places = {name: f"{path.rstrip('/')}/{name}" for name in LISTINGS}
    for name, build in LISTINGS.items():
        write_in_order(build(t), places[name])
    return places
