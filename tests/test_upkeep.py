"""Numbers, scores and indicators after changes against those counted anew."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as contract
from tablero.operators import changes
from tablero.plans import kpi, saving, scoring, upkeep
from tests.frames import ANA, AS_OF, COACHES, CRITERIA, HABITS, LUIS, RETO, START, activity, attendance, base, frame, habit_rows, ratings


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture
def tables(spark):
    return base(
        spark,
        registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS[:4], 6) + habit_rows(2, HABITS[2:5], 3, first_id=500)),
        actividades=frame(spark, "actividades", [activity(n, "Fit Camp", datetime(2024, 1, 1 + n, 10), 1) for n in range(1, 6)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1), attendance(2, 1, 2), attendance(3, 2, 4)]),
        registros_calificaciones=frame(spark, "registros_calificaciones", ratings(1, COACHES[0], [3, -3, 1]) + ratings(2, COACHES[1], [2, 2, 2])))


def habit_batch(spark, rows):
    return spark.createDataFrame(rows, "id_participacion long, fecha_ocurrencia date, nombre_habito string, registro boolean")


def agree(t, after, change):
    """The changed numbers, scoreboard and indicators are those of the changed tables."""
    numbers = upkeep.worths(t)
    assert rows_of(upkeep.updated(numbers, change)) == rows_of(upkeep.worths(after))
    assert rows_of(upkeep.refreshed_scoreboard(t, scoring.scoreboard(t), numbers, change)) == rows_of(scoring.scoreboard(after))
    assert rows_of(upkeep.refreshed_kpis(t, numbers, change, as_of=AS_OF)) == rows_of(kpi.kpis(after, as_of=AS_OF))


def test_scoreboard_from_numbers(spark, tables):
    assert rows_of(upkeep.scoreboard_of(tables, upkeep.worths(tables))) == rows_of(scoring.scoreboard(tables))


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, tables, seed):
    draw = random.Random(seed)
    # Unknown people, days outside the challenge, repeated and contradictory rows are among them.
    habits = habit_batch(spark, [
        (draw.choice([1, 2, 9]), START + timedelta(days=draw.randint(-1, 22)), draw.choice(HABITS[:6]), draw.random() < 0.6) for _ in range(60)])
    places = spark.createDataFrame(
        [(draw.choice([1, 2, 9]), draw.randint(1, 7), draw.random() < 0.5) for _ in range(12)], "id_participacion long, id_actividad long, registro boolean")
    words = spark.createDataFrame(
        [(p, COACHES[draw.randrange(2)], c, draw.choice(["Excelente", "Bueno", None])) for p in (1, 2, 9) for c in CRITERIA],
        "id_participacion long, nombre_coach string, criterio_calificacion string, calificacion string")
    saves = {
        "registros_habitos": (habits, lambda part, rows: saving.save_habits(part, rows, COACHES[0], AS_OF)),
        "registros_actividades": (places, lambda part, rows: saving.save_attendance(part, rows, COACHES[0], AS_OF)),
        "registros_calificaciones": (words, lambda part, rows: saving.save_ratings(part, rows, AS_OF))}
    after = tables.replace(**{log: save(tables, batch).table for log, (batch, save) in saves.items()})
    change = upkeep.saved_deltas(tables, saves)
    assert change.filter("id_participacion = 9").count() == 0
    agree(tables, after, change)


def test_a_save_reads_only_rows_that_it_may_change(spark, tables):
    """Not all rows of a participation: other coaches' ratings, other days and other activities stay in the log."""
    words = spark.createDataFrame([(1, COACHES[1], CRITERIA[0], None), (2, COACHES[1], CRITERIA[0], None), (None, None, CRITERIA[0], "Igual")],
                                  "id_participacion long, nombre_coach string, criterio_calificacion string, calificacion string")
    habits = habit_batch(spark, [(1, START, HABITS[0], False), (1, START, HABITS[0], True), (1, None, HABITS[1], False)])
    places = spark.createDataFrame([(1, 2, False), (2, 1, True)], "id_participacion long, id_actividad long, registro boolean")
    read = {log: upkeep.touched(tables, log, batch) for log, batch in
            {"registros_calificaciones": words, "registros_habitos": habits, "registros_actividades": places}.items()}
    assert {log: rows.count() for log, rows in read.items()} == {"registros_calificaciones": 3, "registros_habitos": 1, "registros_actividades": 1}
    # A blank criterion removes all three ratings of its coach, and those alone.
    save = lambda t, rows: saving.save_ratings(t, rows, AS_OF)
    change = upkeep.saved_deltas(tables, {"registros_calificaciones": (words, save)})
    assert [(r.id_participacion, r._n_calificacion) for r in change.collect()] == [(2, -3)]
    agree(tables, tables.replace(registros_calificaciones=save(tables, words).table), change)


def test_batch_without_effect_changes_nothing(spark, tables):
    batch = habit_batch(spark, [(1, START, HABITS[0], True), (77, START, HABITS[0], True)])
    saves = {"registros_habitos": (batch, lambda part, rows: saving.save_habits(part, rows, COACHES[0], AS_OF))}
    assert upkeep.saved_deltas(tables, saves).count() == 0
    assert upkeep.saved_deltas(tables, {"registros_habitos": (batch.limit(0), saves["registros_habitos"][1])}).count() == 0


def test_whoever_loses_all_rows_is_gone(spark, tables):
    gone = spark.createDataFrame([(2,)], "id_participacion long")
    pairs = {log: (tables[log], changes.delete_keyset(tables[log], gone, ["id_participacion"])) for log in upkeep.LOGS}
    after = tables.replace(**{log: rows for log, (_, rows) in pairs.items()})
    change = upkeep.deltas(tables, pairs)
    agree(tables, after, change)
    board = upkeep.refreshed_scoreboard(tables, scoring.scoreboard(tables), upkeep.worths(tables), change)
    assert {(r.nombre_reto, r.nombre_retador) for r in board.collect()} == {(RETO, ANA)} and LUIS != ANA


def test_changes_add_up(spark, tables):
    """Two changes in a row give the same numbers as both at once."""
    first = habit_batch(spark, [(2, START + timedelta(days=9), h, True) for h in HABITS[:3]])
    second = habit_batch(spark, [(2, START + timedelta(days=9), HABITS[1], False), (1, START, HABITS[0], False)])

    def save(part, rows):
        return saving.save_habits(part, rows, COACHES[0], AS_OF)

    one = upkeep.saved_deltas(tables, {"registros_habitos": (first, save)})
    middle = tables.replace(registros_habitos=save(tables, first).table)
    two = upkeep.saved_deltas(middle, {"registros_habitos": (second, save)})
    after = middle.replace(registros_habitos=save(middle, second).table)
    assert rows_of(upkeep.updated(upkeep.updated(upkeep.worths(tables), one), two)) == rows_of(upkeep.worths(after))


def test_stored_logs_keep_the_rows_of_a_person_together(spark, small):
    t = contract._stored_logs(small)
    for log in upkeep.LOGS:
        files = [[r.id_participacion for r in spark.read.parquet(file).coalesce(1).collect()] for file in t[log].inputFiles()]
        assert files and all(ids == sorted(ids) for ids in files)
        assert rows_of(t[log]) == rows_of(small[log])
