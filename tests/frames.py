"""Small hand-made tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import SparkSession

from tablero.schema import HABIT_WEIGHTS, SCHEMAS
from tablero.sources.tables import Tables

AS_OF = date(2024, 1, 25)
START = date(2024, 1, 1)
END = date(2024, 1, 22)
RETO, ANA, LUIS = "Reto Uno", "Ana Rojas Paz", "Luis Soto Gil"
COACHES = ["Coach Uno Abc", "Coach Dos Abc", "Coach Tres Abc"]
HABITS = [name for name, _ in HABIT_WEIGHTS]
CRITERIA = ["Variación de Peso", "Variación de Medidas", "Apariencia Física"]


def frame(spark: SparkSession, table: str, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMAS[table])


def base(spark: SparkSession, **frames) -> Tables:
    """Two active coaches, one inactive one, one running challenge and two challengers."""
    given = {
        "coaches": frame(spark, "coaches", [
            (1, COACHES[0], "uno1", "999999999", "uno@example.org", "Administrador", True),
            (2, COACHES[1], "dos2", None, None, "Coach", True),
            (3, COACHES[2], "tres3", None, None, "Inactivo", False)]),
        "retadores": frame(spark, "retadores", [
            (1, ANA, date(1990, 5, 5), "Mujer", "900000001", Decimal("1.60"), COACHES[0]),
            (2, LUIS, date(1985, 2, 28), "Hombre", "900000002", Decimal("1.80"), COACHES[1])]),
        "retos": frame(spark, "retos", [(1, RETO, START, END, True)]),
        "participacion": frame(spark, "participacion", [(1, RETO, ANA, "bajar"), (2, RETO, LUIS, None)]),
    }
    return Tables.of(spark, **{**given, **frames})


def habit_rows(person: int, habits: list[str], days: int, coach: str = COACHES[0], first_id: int = 1) -> list[tuple]:
    rows = []
    for d in range(days):
        for h in habits:
            day = START + timedelta(days=d)
            rows.append((first_id + len(rows), person, day, h, "Habitos", coach, day))
    return rows


def activity(id_: int, kind: str, start: datetime, hours: float, reto: str = RETO) -> tuple:
    return (id_, kind, start, start + timedelta(hours=hours), reto, "Tema", COACHES[0])


def attendance(id_: int, person: int, activity_id: int) -> tuple:
    return (id_, person, activity_id, "Actividades", COACHES[0], START)


def ratings(person: int, coach: str, values: list[int]) -> list[tuple]:
    first = person * 1000 + COACHES.index(coach) * 10
    return [(first + n, person, c, coach, v, "Calificacion", START) for n, (c, v) in enumerate(zip(CRITERIA, values, strict=True))]
