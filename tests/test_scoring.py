from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tablero.plans import kpi, scoring
from tests.frames import ANA, COACHES, CRITERIA, HABITS, LUIS, RETO, activity, attendance, base, frame, habit_rows, ratings


def scores(df, person=ANA):
    return {r.concepto: (r.puntaje, r.total) for r in df.filter(df.nombre_retador == person).collect()}


def test_perfect_score_is_one_hundred(spark):
    t = base(
        spark,
        registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS, 21)),
        actividades=frame(spark, "actividades", [
            activity(1, "Fit Camp", datetime(2024, 1, 2, 10), 1), activity(2, "Fit Camp", datetime(2024, 1, 3, 10), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1), attendance(2, 1, 2)]),
        registros_calificaciones=frame(
            spark, "registros_calificaciones", ratings(1, COACHES[0], [3, 3, 3]) + ratings(1, COACHES[1], [3, 3, 3])))
    got = scores(scoring.scoreboard(t))
    assert got == {"Habitos": (45.0, 100.0), "Actividades": (10.0, 100.0), "Calificacion": (45.0, 100.0)}


def test_negative_component_does_not_lower_the_total(spark):
    t = base(
        spark,
        registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS, 21)),
        registros_calificaciones=frame(
            spark, "registros_calificaciones", ratings(1, COACHES[0], [-3, -3, -3]) + ratings(1, COACHES[1], [-3, -3, -3])))
    assert scores(scoring.scoreboard(t)) == {"Habitos": (45.0, 45.0), "Calificacion": (0.0, 45.0)}
    assert scoring.score_ratings(t).first().puntaje == -45.0


def test_absent_coach_counts_as_zero_and_inactive_coach_counts_on_top(spark):
    one = frame(spark, "registros_calificaciones", ratings(1, COACHES[0], [3, 3, 3]))
    assert scores(scoring.scoreboard(base(spark, registros_calificaciones=one))) == {"Calificacion": (22.5, 22.5)}
    both = one.union(frame(spark, "registros_calificaciones", ratings(1, COACHES[2], [3, 3, 3])))
    assert scores(scoring.scoreboard(base(spark, registros_calificaciones=both))) == {"Calificacion": (45.0, 45.0)}


def test_ceremony_counts_for_those_who_came_but_not_in_the_divisor(spark):
    t = base(
        spark,
        actividades=frame(spark, "actividades", [
            activity(1, "Ceremonia", datetime(2024, 1, 2, 10), 1), activity(2, "Fit Camp", datetime(2024, 1, 3, 10), 1),
            activity(3, "Fit Camp", datetime(2024, 1, 4, 10), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1), attendance(2, 1, 2)]))
    assert scores(scoring.scoreboard(t)) == {"Actividades": (10.0, 10.0)}


def test_challenge_without_scored_activities_gives_no_activity_points(spark):
    t = base(
        spark,
        actividades=frame(spark, "actividades", [activity(1, "Ceremonia", datetime(2024, 1, 2, 10), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1)]))
    assert scoring.scoreboard(t).count() == 0
    assert scoring.daily_scoreboard(t).count() == 0


def test_filters_give_the_same_rows_as_the_full_result(small):
    for build in (scoring.scoreboard, scoring.daily_scoreboard, scoring.ranking, scoring.habit_counts, scoring.rating_means):
        full = build(small)
        person = full.select("nombre_reto", "nombre_retador").orderBy("nombre_reto", "nombre_retador").first()
        own = full.filter((F.col("nombre_reto") == person[0]) & (F.col("nombre_retador") == person[1]))
        part = build(small, reto=person[0], retador=person[1])
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, own.collect()))
        challenge = build(small, reto=person[0])
        assert challenge.count() == full.filter(F.col("nombre_reto") == person[0]).count()


def test_daily_habit_points_add_up(small):
    daily = scoring.daily_habits(small).groupBy("nombre_retador").agg(F.sum("puntaje").alias("suma"))
    whole = scoring.score_habits(small).join(daily, "nombre_retador")
    assert whole.filter(F.abs(F.col("suma") - F.col("puntaje")) > 1e-4).count() == 0


def test_ranking_shares_places(spark):
    t = base(
        spark, registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS, 3) + habit_rows(2, HABITS, 3, first_id=99)))
    assert {(r.nombre_retador, r.puesto) for r in scoring.ranking(t).collect()} == {(ANA, 1), (LUIS, 1)}


def test_kpis_without_logs_are_null_but_listed(spark):
    t = base(spark)
    row = kpi.kpis(t, as_of=date(2024, 1, 5)).first()
    assert (row.nombre_reto, row.retadores, row.habitos, row.actividades) == (RETO, 2, None, None)
    shown = kpi.kpis_display(t, as_of=date(2024, 1, 5)).first()
    assert (shown.habitos, shown.actividades) == (None, None)


@pytest.mark.parametrize(("as_of", "days"), [
    (date(2024, 1, 1), 1), (date(2024, 1, 21), 21), (date(2024, 1, 22), 21), (date(2025, 1, 1), 21), (date(2023, 12, 30), -1)])
def test_elapsed_days(spark, as_of, days):
    assert kpi.challenge_progress(base(spark), as_of=as_of).first().num_dias == days


def test_kpi_rates(spark):
    t = base(
        spark,
        registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS, 2)),
        actividades=frame(spark, "actividades", [
            activity(1, "Fit Camp", datetime(2024, 1, 2, 10), 1), activity(2, "Fit Camp", datetime(2024, 1, 9, 10), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1)]))
    row = kpi.kpis(t, as_of=date(2024, 1, 4)).first()
    assert (row.habitos, row.actividades) == (0.25, 0.5)
    assert kpi.kpis_display(t, as_of=date(2024, 1, 4)).first().habitos == "25.00%"
    assert kpi.kpis(t, as_of=date(2024, 1, 4), ids=[7]).count() == 0


def test_rating_means_divide_by_active_coaches(spark):
    t = base(spark, registros_calificaciones=frame(spark, "registros_calificaciones", ratings(1, COACHES[0], [3, 1, -2])))
    assert {r.criterio_calificacion: r.prom for r in scoring.rating_means(t).collect()} == dict(zip(CRITERIA, [1.5, 0.5, -1.0], strict=True))
