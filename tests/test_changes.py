from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tablero.functions.text import blank_to_null
from tablero.operators import changes
from tablero.plans import quality, saving
from tests.frames import ANA, COACHES, CRITERIA, HABITS, RETO, START, activity, base, frame, habit_rows, ratings

TODAY = date(2024, 1, 25)
HABIT_KEY = ["id_participacion", "fecha_ocurrencia", "nombre_habito"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_numbers_follow_the_largest_id_and_take_defaults(spark):
    target = base(spark).participacion
    new = spark.createDataFrame([("Otro Reto", "Rosa"), ("Otro Reto", "Juan")], "nombre_reto string, nombre_retador string")
    out = changes.insert_rows(target, new, "id_participacion", ["nombre_retador"], {"objetivo_participacion": F.lit("salud")})
    assert out.columns == target.columns
    assert sorted(r.id_participacion for r in out.collect()) == [1, 2, 3, 4]
    assert {r.objetivo_participacion for r in out.filter("id_participacion > 2").collect()} == {"salud"}
    first = changes.insert_rows(target.limit(0), new, "id_participacion", ["nombre_retador"])
    assert sorted(r.id_participacion for r in first.collect()) == [1, 2]


def test_update_writes_nulls_too(spark):
    target = base(spark).participacion
    new = spark.createDataFrame([(1, None)], "id_participacion long, objetivo_participacion string")
    assert rows(changes.update_rows(target, new, ["id_participacion"])) == [(1, RETO, ANA, None), (2, RETO, "Luis Soto Gil", None)]


def test_measurements_upsert(spark):
    target = frame(spark, "registros_parametros", [(7, 1, "Peso", 80.0, 79.0), (8, 2, "Peso", 70.0, None)])
    new = spark.createDataFrame(
        [(1, "Peso", 81.0, None), (1, "Medida Cintura", 90.0, 88.0), (2, "Medida Cintura", None, 70.0)],
        "id_participacion long, nombre_parametro string, valor_inicial double, valor_final double")
    once = changes.upsert_measurements(target, new)
    assert rows(once) == [(7, 1, "Peso", 81.0, None), (8, 2, "Peso", 70.0, None), (9, 1, "Medida Cintura", 90.0, 88.0)]
    assert rows(changes.upsert_measurements(once, new)) == rows(once)


def test_first_registration_wins_however_the_rows_are_split(spark):
    data = habit_rows(1, HABITS, 2) + habit_rows(1, HABITS, 2, coach=COACHES[1], first_id=50)
    every = frame(spark, "registros_habitos", data)
    empty = every.limit(0)
    whole = changes.upsert_skip_existing(empty, every, HABIT_KEY, order=["id_registro_habito"])
    split = empty
    for part in (data[:3], data[3:20], data[20:]):
        split = changes.upsert_skip_existing(split, frame(spark, "registros_habitos", part), HABIT_KEY, order=["id_registro_habito"])
    assert rows(whole) == rows(split) == rows(frame(spark, "registros_habitos", habit_rows(1, HABITS, 2)))


def test_save_habits_adds_ticked_and_removes_unticked(spark):
    target = frame(spark, "registros_habitos", habit_rows(1, HABITS[:2], 1, coach=COACHES[0]))
    grid = spark.createDataFrame(
        [(1, START, HABITS[0], False), (1, START, HABITS[1], True), (1, START, HABITS[2], True)],
        "id_participacion long, fecha_ocurrencia date, nombre_habito string, registro boolean")
    saved = changes.save_habits(target, grid, COACHES[1], TODAY).collect()
    assert {(r.nombre_habito, r.nombre_coach, r.fecha_registro) for r in saved} == {
        (HABITS[1], COACHES[0], START), (HABITS[2], COACHES[1], TODAY)}
    assert {r.concepto for r in saved} == {"Habitos"}
    other = changes.save_habits(target, grid, COACHES[1], TODAY, role="Coach").collect()
    assert HABITS[0] in {r.nombre_habito for r in other}


def grid_of(spark, words):
    return spark.createDataFrame(
        [(1, COACHES[0], c, w) for c, w in zip(CRITERIA, words, strict=True)],
        "id_participacion long, nombre_coach string, criterio_calificacion string, calificacion string")


def test_one_blank_criterion_removes_all_ratings_of_that_coach(spark):
    target = frame(spark, "registros_calificaciones", ratings(1, COACHES[0], [1, 1, 1]) + ratings(1, COACHES[1], [2, 2, 2]))
    grid = grid_of(spark, ["Mejor", "Igual", None])
    kept = changes.save_ratings(target, grid, TODAY)
    assert {r.nombre_coach for r in kept.collect()} == {COACHES[1]}
    strict = changes.save_ratings(target, grid, TODAY, strict_criterion=True).filter(F.col("nombre_coach") == COACHES[0])
    assert {(r.criterio_calificacion, r.calificacion, r.fecha_registro) for r in strict.collect()} == {
        (CRITERIA[0], 2, TODAY), (CRITERIA[1], 0, TODAY)}


def test_complete_grid_updates_and_inserts(spark):
    target = frame(spark, "registros_calificaciones", ratings(1, COACHES[0], [1, 1, 1])[:1])
    saved = changes.save_ratings(target, grid_of(spark, ["Mucho Peor", "Peor", "Ligeramente Mejor"]), TODAY).collect()
    assert {(r.criterio_calificacion, r.calificacion) for r in saved} == set(zip(CRITERIA, [-3, -2, 1], strict=True))
    assert {(r.concepto, r.fecha_registro) for r in saved} == {("Calificacion", TODAY)}


def test_photo_date_moves_only_for_the_same_coach(spark):
    target = frame(spark, "fotos", [
        (1, 1, "Frente", "Inicial", "AA", START, COACHES[0]), (2, 1, "Perfil", "Inicial", "BB", START, COACHES[0])])
    new = spark.createDataFrame(
        [(1, "Frente", "Inicial", "CC", COACHES[0]), (1, "Perfil", "Inicial", "DD", COACHES[1]), (1, "Frente", "Final", "EE", COACHES[1])],
        "id_participacion long, tipo string, estado string, archivo string, nombre_coach string")
    assert rows(changes.upsert_photos(target, new, TODAY)) == [
        (1, 1, "Frente", "Inicial", "CC", TODAY, COACHES[0]), (2, 1, "Perfil", "Inicial", "DD", START, COACHES[1]),
        (3, 1, "Frente", "Final", "EE", TODAY, COACHES[1])]


def test_repeated_keys_change_a_row_once(spark):
    target = base(spark).participacion
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "c", 1)], "id_participacion long, objetivo_participacion string, n int")
    once = changes.update_rows(target, new, ["id_participacion"], ["objetivo_participacion"])
    assert [r.objetivo_participacion for r in once.filter("id_participacion = 1").collect()] == ["a"]
    first = changes.update_rows(target, new, ["id_participacion"], ["objetivo_participacion"], order=["n"])
    assert [r.objetivo_participacion for r in first.filter("id_participacion = 1").collect()] == ["c"]
    photos = frame(spark, "fotos", [(1, 1, "Frente", "Inicial", "AA", START, COACHES[0])])
    twice = spark.createDataFrame([(1, "Frente", e, x, COACHES[0]) for e in ("Inicial", "Final") for x in ("DD", "CC")],
                                  "id_participacion long, tipo string, estado string, archivo string, nombre_coach string")
    assert rows(changes.upsert_photos(photos, twice, TODAY).select("id_foto", "archivo")) == [(1, "CC"), (2, "CC")]


def test_saves_reject_what_the_rules_forbid(spark):
    closed, late = "Reto Dos", START + timedelta(days=30)
    t = base(
        spark, retos=frame(spark, "retos", [(1, RETO, START, date(2024, 1, 22), True), (2, closed, START, date(2024, 1, 22), False)]),
        participacion=frame(spark, "participacion", [(1, RETO, ANA, None), (2, closed, ANA, None)]),
        actividades=frame(spark, "actividades", [activity(5, "Fit Camp", datetime(2024, 1, 2, 10), 1), activity(6, "Fit Camp", datetime(2024, 1, 2, 10), 1, reto=closed)]))
    grid = spark.createDataFrame(
        [(1, START, "a", True), (1, late, "a", True), (1, late, "b", False), (2, START, "a", True), (9, START, "a", False), (1, date(2024, 1, 21), "a", True)],
        "id_participacion long, fecha_ocurrencia date, nombre_habito string, registro boolean")
    table, rejected = saving.save_habits(t, grid, COACHES[0], date(2024, 1, 20))
    assert rows(table.select("id_participacion", "fecha_ocurrencia")) == [(1, START)]
    assert {(r.id_participacion, r.fecha_ocurrencia, r.motivos) for r in rejected.collect()} == {
        (1, late, "fuera_de_reto,fecha_futura"), (2, START, "reto_inactivo"), (9, START, "participacion_desconocida"), (1, date(2024, 1, 21), "fecha_futura")}
    marks = spark.createDataFrame([(1, 5, True), (1, 6, True), (1, 7, True), (2, 6, True)], "id_participacion long, id_actividad long, registro boolean")
    table, rejected = saving.save_attendance(t, marks, COACHES[0], TODAY)
    assert rows(table.select("id_participacion", "id_actividad")) == [(1, 5)]
    assert {(r.id_participacion, r.id_actividad, r.motivos) for r in rejected.collect()} == {
        (1, 6, "actividad_de_otro_reto"), (1, 7, "actividad_desconocida"), (2, 6, "reto_inactivo")}
    rated = spark.createDataFrame([(p, COACHES[0], c, "Mejor") for p in (1, 2) for c in CRITERIA], "id_participacion long, nombre_coach string, criterio_calificacion string, calificacion string")
    table, rejected = saving.save_ratings(t, rated, TODAY)
    assert table.count() == 3 and {r.id_registro_calificacion for r in table.collect()} == {1, 2, 3} and rejected.count() == 3
    photo = spark.createDataFrame([(2, "Frente", "Final", "AA", COACHES[0])], "id_participacion long, tipo string, estado string, archivo string, nombre_coach string")
    table, rejected = saving.save_photos(t, photo, TODAY)
    assert table.count() == 0 and [r.motivos for r in rejected.collect()] == ["reto_inactivo"]


def test_saved_test_tables_break_no_rule(small):
    habits = saving.save_habits(small, small["lote_checklist"], COACHES[0], TODAY).table
    attended = saving.save_attendance(small, small["lote_asistencia"], COACHES[0], TODAY).table
    saved = small.replace(registros_habitos=habits, registros_actividades=attended)
    for rule in (quality.dq_habit_range, quality.dq_attendance_reto):
        assert rule(saved, as_of=TODAY).count() == 0
    before, after = (quality.dq_inactive(x, tables=("registros_habitos", "registros_actividades")).select("tabla", "clave") for x in (small, saved))
    assert after.exceptAll(before).count() == 0


def test_guard_rename_alerts_and_blanks(spark):
    t = base(spark)
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id_retador long, dato string")
    seen = changes.guarded_changes(asked, t.retadores, "id_retador", COACHES[1], "Coach").collect()
    assert {(r.id_retador, r.aceptado) for r in seen} == {(1, False), (2, True), (3, False)}
    assert all(r.aceptado for r in changes.guarded_changes(asked, t.retadores, "id_retador", "", "Administrador").collect())
    names = spark.createDataFrame([(RETO, "Reto Dos")], "viejo string, nuevo string")
    assert {r.nombre_reto for r in changes.cascade_rename(t.participacion, "nombre_reto", names).collect()} == {"Reto Dos"}
    assert {(r.id_coach, r.notificacion_correo) for r in changes.normalize_alerts(t.coaches).collect()} == {
        (1, True), (2, False), (3, False)}
    form = spark.createDataFrame([(0, "", 0, 0.0), (5, "x", 2, 1.5)], "id long, a string, b int, c double")
    assert rows(blank_to_null(form, keep=("id",))) == [(0, None, None, None), (5, "x", 2, 1.5)]


def test_delete_keyset_own_rows_only(spark):
    target = frame(spark, "registros_habitos", habit_rows(1, HABITS[:1], 2) + habit_rows(1, HABITS[1:2], 2, coach=COACHES[1], first_id=9))
    keys = spark.createDataFrame([(1,)], "id_participacion long")
    assert changes.delete_keyset(target, keys, ["id_participacion"]).count() == 0
    left = changes.delete_keyset(target, keys, ["id_participacion"], me=COACHES[1], role="Coach")
    assert {r.nombre_coach for r in left.collect()} == {COACHES[0]}
