from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tablero.functions.dates import minutes_between
from tablero.plans import calendar, kpi, photos, quality, reports, scoring, views
from tablero.schema import SCHEMAS
from tablero.sources.tables import Tables, save, seed
from tests.frames import AS_OF, HABITS, RETO, base, frame, habit_rows


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_tables_survive_a_round_trip(spark, small, tmp_path, fmt):
    for table in ("retos", "participacion", "registros_habitos", "actividades", "habitos"):
        save(small[table].select(*SCHEMAS[table].fieldNames()), str(tmp_path), table, fmt)
    t = Tables.load(spark, str(tmp_path), fmt)
    for table in ("retos", "participacion", "registros_habitos", "actividades", "habitos"):
        assert [(f.name, f.dataType) for f in t[table].schema] == [(f.name, f.dataType) for f in SCHEMAS[table]]
        names = SCHEMAS[table].fieldNames()
        assert sorted(map(tuple, t[table].collect())) == sorted(map(tuple, small[table].select(*names).collect()))
    assert sorted(map(tuple, kpi.challenge_progress(t, as_of=AS_OF).collect())) == sorted(map(tuple, kpi.challenge_progress(small, as_of=AS_OF).collect()))


def test_saving_twice_is_an_error(spark, tmp_path):
    save(seed(spark, "habitos"), str(tmp_path), "habitos")
    with pytest.raises(Exception, match="(?i)exist"):
        save(seed(spark, "habitos"), str(tmp_path), "habitos")


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="xml"):
        Tables.load(spark, "/nowhere", "xml").retos.count()


def test_seeds(spark):
    for table, total in (("conceptos", 3), ("habitos", 7), ("criterios_calificacion", 3), ("parametros", 2)):
        df = seed(spark, table)
        assert df.count() == total
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SCHEMAS[table]]


def named(name, build):
    build.__name__ = name
    return build


READS = [
    *(getattr(scoring, n) for n in (
        "score_habits", "score_activities", "score_ratings", "scoreboard", "ranking", "habit_counts", "rating_means", "daily_habits",
        "daily_activities", "daily_ratings", "daily_scoreboard")),
    *(named(f.__name__, lambda t, f=f: f(t, as_of=AS_OF)) for f in (kpi.kpis, kpi.kpis_display, kpi.challenge_progress, views.challenger_age)),
    *(getattr(views, n) for n in (
        "scan_coaches", "active_coaches", "challenges", "active_challenges", "challenge_names", "all_logs", "participation_lookup",
        "roster", "activities", "activity_labels", "measurements_dense", "measurement_deltas", "habit_checklist")),
    named("attendance_checklist", lambda t: views.attendance_checklist(t, actividades=t.actividades)),
    *(named(f.__name__, lambda t, f=f: f(t, HABITS)) for f in (reports.pivot_habit_counts, reports.pivot_habit_days)), reports.habit_days, reports.attendance_report, reports.ratings_report, reports.report_names,
    calendar.calendar_feed, calendar.activity_calendar, calendar.group_slots, calendar.hidden_calendars, calendar.ical_events, named("calendar_parts", lambda t: calendar.calendar_parts(calendar.ical_events(t))),
    photos.photos_decoded, photos.pivot_photos,
]


@pytest.mark.parametrize("build", READS, ids=lambda f: f.__name__)
def test_empty_tables_give_empty_results_of_the_same_shape(spark, small, build):
    empty = build(Tables.of(spark))
    assert empty.count() == 0
    assert [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in build(small).schema]


def test_write_reports(spark, small, tmp_path):
    places = reports.write_reports(small, str(tmp_path), reto="Reto ASIA")
    assert set(places) == set(reports.REPORTS)
    back = spark.read.parquet(places["puntajes"])
    assert {r.nombre_reto for r in back.select("nombre_reto").distinct().collect()} == {"Reto ASIA"}
    assert back.count() == scoring.scoreboard(small, reto="Reto ASIA").count()


def test_calendar_files(spark, small, tmp_path):
    events = calendar.ical_events(small, ids=[1, 2])
    calendar.write_ical(events, str(tmp_path / "ics"))
    files = [p.read_bytes().decode() for p in (tmp_path / "ics").glob("id_reto=*/*.txt")]
    text = "".join(files)
    assert text.count("BEGIN:VCALENDAR") == text.count("END:VCALENDAR") == text.count("BEGIN:VEVENT") == events.count()
    assert "\r\n" in text and "\r\r" not in text
    one = calendar.ical_events(small, ids=[1]).orderBy("dtstart").first()
    assert f"UID:{one.uid}\r\nDTSTAMP:{one.dtstart}\r\nDTSTART:{one.dtstart}\r\nDTEND:{one.dtend}\r\nSUMMARY:{one.summary}" in text
    assert all(file.startswith("BEGIN:VCALENDAR\r\n") for file in files if file)


def test_one_calendar_file_per_challenge(spark, tmp_path):
    """100,000 events of one challenge and one of another: several files, put together by name, are one calendar in order of time."""
    made = spark.range(100_001).selectExpr(
        "id AS id_actividad", "'Charla' AS actividad", "concat('t', id) AS tema_actividad", "'C' AS coach_expositor", "if(id = 7, 'S', 'R') AS nombre_reto",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(pmod(xxhash64(id), 50000)), 0) AS inicio", "timestamp_ntz'2025-01-01 00:00:00' AS fin")
    t = base(spark, actividades=made, retos=spark.createDataFrame([(1, "R", True), (2, "S", True), (3, "T", True)], "id_reto long, nombre_reto string, reto_activo boolean"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        calendar.write_calendars(calendar.calendar_parts(calendar.ical_events(t)), str(tmp_path / "ics"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "ics" / "id_reto=1").glob("*.txt"))
    text = b"".join(p.read_bytes() for p in files).decode()
    assert len(files) > 2 and text.count("BEGIN:VEVENT\r\n") == text.count("END:VEVENT\r\n") == 100_000
    assert text.startswith("BEGIN:VCALENDAR\r\nPRODID:") and text.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n")
    assert text.count("BEGIN:VCALENDAR") == text.count("END:VCALENDAR") == text.count("VERSION:2.0") == 1
    starts = [line for line in text.split("\r\n") if line.startswith("DTSTART:")]
    assert starts == sorted(starts) and "\n" not in text.replace("\r\n", "")
    single = b"".join(p.read_bytes() for p in (tmp_path / "ics" / "id_reto=2").glob("*.txt")).decode().split("\r\n")
    assert single[0] == "BEGIN:VCALENDAR" and single[-2] == "END:VCALENDAR" and single.count("BEGIN:VEVENT") == 1
    assert not (tmp_path / "ics" / "id_reto=3").exists()


def test_photo_files_round_trip(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(bytes(range(256)))
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = photos.photos_encode(spark, str(tmp_path), "*.jpg")
    assert rows.count() == 1
    decoded = photos.decode(rows).first()
    assert bytes(decoded.contenido) == bytes(range(256))
    bad = spark.createDataFrame([("zz",), ("41",)], "archivo string")
    assert [r.contenido for r in photos.decode(bad).collect()] == [None, bytearray(b"A")]


def test_filters(small):
    person = small.participacion.orderBy("id_participacion").first()
    for build in (views.roster, views.participation_lookup, views.habit_checklist, views.all_logs, photos.photos_decoded):
        part = build(small, reto=person.nombre_reto, retador=person.nombre_retador)
        assert {r.id_participacion for r in part.select("id_participacion").distinct().collect()} <= {person.id_participacion}
    day = views.challenges(small, reto=person.nombre_reto).first().fecha_inicio
    assert views.habit_checklist(small, reto=person.nombre_reto, retador=person.nombre_retador, fecha=day).count() == 7
    assert views.roster_visible(small, me="", role="Administrador").count() == views.roster(small).count()


def test_no_calendar_selected_hides_all_active(small):
    active = [r.id_reto for r in small.retos.filter("reto_activo").collect()]
    assert calendar.hidden_calendars(small).count() == len(active)
    assert calendar.hidden_calendars(small, selected=active).count() == 0


def test_calendar_text_is_escaped_and_folded(spark):
    rows = [(1, "Fit Camp", "a;b,c\\d\nATTENDEE:x " + "é" * 90, "y" * 200)]
    made = spark.createDataFrame(rows, "id_actividad long, actividad string, tema_actividad string, coach_expositor string").selectExpr(
        "*", "'R' AS nombre_reto", "TIMESTAMP_NTZ'2024-01-02 10:00:00' AS inicio", "TIMESTAMP_NTZ'2024-01-02 11:00:00' AS fin")
    t = base(spark, actividades=made, retos=spark.createDataFrame([(1, "R", True)], "id_reto long, nombre_reto string, reto_activo boolean"))
    text = calendar.ical_text(calendar.ical_events(t)).first().value
    lines = text.split("\r\n")
    assert all(len(line.encode()) <= 75 for line in lines) and "\n" not in text.replace("\r\n", "")
    whole = text.replace("\r\n ", "")
    assert "DESCRIPTION:R\\n - a\\;b\\,c\\\\d\\nATTENDEE:x " + "é" * 90 + "\\n - " + "y" * 200 in whole
    assert not any(line.startswith("ATTENDEE") for line in lines)


def test_pivots_count_what_is_in_no_column(spark):
    t = base(spark, registros_habitos=frame(spark, "registros_habitos", habit_rows(1, [f"h{i}" for i in range(1500)], 1)), habitos=frame(spark, "habitos", []))
    counts = reports.pivot_habit_counts(t, ["h1", "h2"]).first()
    assert (counts.h1, counts.h2, counts.otros) == (1, 1, 1498)
    days = reports.pivot_habit_days(t, ["h1"]).first()
    assert (days.h1, days.otros) == ("uno1", 1499)
    assert reports.habit_days(t).count() == 1500


def test_minutes_keep_fractions(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-31 23:59:30.25' AS a, TIMESTAMP_NTZ'2024-02-01 00:00:29.75' AS b")
    assert row.select(minutes_between(F.col("a"), F.col("b"))).first()[0] == 59.5 / 60


def test_age_filter_by_challenge(spark):
    t = base(spark)
    assert views.challenger_age(t, as_of=AS_OF, reto=RETO).count() == 2 and views.challenger_age(t, as_of=AS_OF, reto="x").count() == 0


def test_report_headings(spark):
    assert reports.scoreboard_report(base(spark)).columns == ["Reto", "Retador", "Concepto", "Puntaje", "Total"]


def test_no_cartesian_or_python_step_in_any_plan(spark):
    """Also where Spark broadcasts nothing."""
    broadcast_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = contract.queries()
        for key in {**contract.READS, **contract.RULES, **contract.CHANGES}:
            build = queries[key]
            plan = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
                assert step not in plan, (key, step)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_limit)


def test_no_join_of_many_rows_on_a_hot_key_alone(spark, small, tmp_path):
    """Over stored tables, with broadcasting off: challenge, activity and coach are joined in parts."""
    for table in SCHEMAS:
        save(small[table].select(*SCHEMAS[table].fieldNames()), str(tmp_path), table)
    t = Tables.load(spark, str(tmp_path))
    broadcast_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build in (
            quality.dq_activity_range, quality.dq_habit_range, quality.dq_attendance_reto, quality.dq_multi_active, quality.dq_shared_challengers,
            quality.dq_inactive, quality.dq_orphans, reports.attendance_report, reports.ratings_report, reports.report_names, reports.habit_days,
            calendar.calendar_feed, calendar.ical_events,
        ):
            df = build(t, as_of=AS_OF) if build in quality.RULES.values() else build(t)
            plan = df._jdf.queryExecution().executedPlan().toString()
            alone = re.findall(r"Join \[(?:nombre_reto|id_actividad|nombre_coach)#\d+\w*\], \[(?:nombre_reto|id_actividad|nombre_coach)#\d+\w*\]", plan)
            assert not alone, (build.__name__, alone)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_limit)


def test_challenge_filter_reaches_the_scan(spark, small, tmp_path):
    save(small.participacion, str(tmp_path), "participacion")
    t = Tables.load(spark, str(tmp_path))
    df = views.participation_lookup(t.replace(retadores=small.retadores), reto=RETO)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(nombre_reto," in plan


def test_rules_accept_tables_without_rows(spark):
    t = Tables.of(spark)
    for name, rule in quality.RULES.items():
        df = rule(t, as_of=AS_OF)
        assert df.columns == quality.COLUMNS, name
        assert df.count() == 0, name
    assert quality.delete_blocked(t).filter(F.col("tabla") == "retos").count() == 0
