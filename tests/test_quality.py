from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

from tablero.plans import quality, views
from tablero.schema import FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS
from tablero.sources.tables import seed_weights
from tests.frames import AS_OF, COACHES, HABITS, RETO, START, activity, base, frame, habit_rows, ratings


def found(df):
    return {(r.clave, r.detalle) for r in df.collect()}


def test_sound_tables_have_no_violations(spark):
    t = base(spark, registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS, 3)))
    for name, rule in quality.RULES.items():
        assert found(rule(t, as_of=AS_OF)) == set(), name


def test_only_expected_findings_on_clean_test_data(small):
    for name, rule in quality.RULES.items():
        if name in ("dq_format", "dq_inactive"):  # generated names have one word; logs of the closed challenge are kept
            continue
        assert rule(small, as_of=AS_OF).count() == 0, name


def test_touching_activities_overlap_once_each(spark):
    t = base(spark, actividades=frame(spark, "actividades", [
        activity(1, "Fit Camp", datetime(2024, 1, 2, 10), 1), activity(2, "Fit Camp", datetime(2024, 1, 2, 11), 1),
        activity(3, "Fit Camp", datetime(2024, 1, 2, 14), 1)]))
    assert found(quality.dq_activity_overlap(t)) == {("1", "1"), ("2", "1")}


def test_activity_may_not_end_at_midnight_after_the_last_day(spark):
    t = base(spark, actividades=frame(spark, "actividades", [
        activity(1, "Fit Camp", datetime(2024, 1, 21, 23), 1), activity(2, "Ceremonia", datetime(2024, 1, 21, 23), 1),
        activity(3, "Fit Camp", datetime(2024, 1, 21, 22), 1), activity(4, "Fit Camp", datetime(2024, 1, 1, 0), 1)]))
    assert {k for k, _ in found(quality.dq_activity_range(t))} == {"1"}


def test_weights(spark):
    good = base(spark)
    assert found(quality.dq_weight_sum(good)) == set()
    low = base(spark, habitos=frame(spark, "habitos", [(1, "a", Decimal("0.50"))]))
    assert found(quality.dq_weight_sum(low)) == set()
    high = base(spark, habitos=frame(spark, "habitos", [(1, "a", Decimal("0.60")), (2, "b", Decimal("0.41"))]))
    assert found(quality.dq_weight_sum(high)) == {("total", "1.01")}
    wild = base(spark, habitos=frame(spark, "habitos", [(1, "a", Decimal("1.20")), (2, "b", Decimal("-0.40"))]))
    assert found(quality.dq_weight_sum(wild)) == {("a", "1.20"), ("b", "-0.40")}


def test_seed_weights(spark):
    rows = seed_weights(base(spark)).collect()
    sums = {}
    for r in rows:
        sums[r.tabla] = round(sums.get(r.tabla, 0) + r.peso, 2)
    assert sums == {"conceptos": 1.0, "habitos": 1.0, "criterios_calificacion": 1.0}


def test_ratings_components_and_nulls(spark):
    rows = [*ratings(1, COACHES[0], [4, 0, -4])]
    rows[1] = rows[1][:5] + ("Habitos", START)
    t = base(spark, registros_calificaciones=frame(spark, "registros_calificaciones", rows))
    assert {d for _, d in found(quality.dq_rating_range(t))} == {"4", "-4"}
    assert {d for _, d in found(quality.dq_component(t))} == {"Habitos"}
    loose = spark.createDataFrame([(1, None, None)], "id_reto long, nombre_reto string, fecha_ini date")
    assert found(quality.dq_nulls(base(spark, retos=loose), tables=("retos",))) == {("1", "nombre_reto"), ("1", "fecha_ini")}


def test_formats(spark):
    t = base(spark, coaches=frame(spark, "coaches", [
        (1, "Ana Rojas", "abc", "12345678", "x@y", "Coach", False),
        (2, "An R", "con espacio", "123456789", "Ana.R@Example.ORG", "Coach", False),
        (3, "Ana Ro", "ñandu1", None, None, "Coach", False)]))
    assert found(quality.dq_format(t)) == {
        ("1", "user_coach=abc"), ("1", "num_celular_coach=12345678"), ("1", "email_coach=x@y"), ("2", "nombre_coach=An R"),
        ("2", "user_coach=con espacio"), ("3", "nombre_coach=Ana Ro"), ("3", "user_coach=ñandu1")}


def test_duplicate_and_orphan_rows(spark):
    t = base(spark, participacion=frame(spark, "participacion", [
        (1, RETO, "Ana Rojas Paz", None), (2, RETO, "Ana Rojas Paz", None), (3, "Otro", "Nadie", None)]))
    assert found(quality.dq_duplicates(t)) == {(f"{RETO}|Ana Rojas Paz", "2")}
    assert found(quality.dq_orphans(t)) == {("3", "Otro"), ("3", "Nadie")}


def test_challenger_in_two_active_challenges(spark):
    retos = [(1, "A", START, date(2024, 1, 22), True), (2, "B", START, date(2024, 1, 22), True), (3, "C", START, date(2024, 1, 22), False)]
    people = [(1, "A", "x", None), (2, "B", "x", None), (3, "C", "x", None), (4, "A", "y", None), (5, "C", "y", None)]
    t = base(spark, retos=frame(spark, "retos", retos), participacion=frame(spark, "participacion", people))
    assert found(quality.dq_multi_active(t)) == {("x", "2")}
    assert found(quality.dq_shared_challengers(t)) == {("A", "x"), ("B", "x")}
    assert found(quality.dq_inactive(t, tables=("participacion",))) == {("3", "C"), ("5", "C")}


def test_inactive_challenges_freeze_six_tables(spark):
    t = base(
        spark, retos=frame(spark, "retos", [(1, RETO, START, date(2024, 1, 22), False)]),
        fotos=frame(spark, "fotos", [(4, 1, "Frente", "Inicial", "AA", START, COACHES[0])]),
        actividades=frame(spark, "actividades", [activity(5, "Fit Camp", datetime(2024, 1, 2, 10), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [(6, 1, 5, "Actividades", COACHES[0], START)]),
        registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS[:1], 1, first_id=7)),
        registros_calificaciones=frame(spark, "registros_calificaciones", ratings(1, COACHES[0], [1, 1, 1])[:1]))
    got = {(r.tabla, r.clave) for r in quality.dq_inactive(t).collect()}
    assert got == {("participacion", "1"), ("participacion", "2"), ("fotos", "4"), ("actividades", "5"), ("registros_actividades", "6"),
                   ("registros_habitos", "7"), ("registros_calificaciones", "1000")}


def test_keys_written_out_once_more():
    """The keys as the tables declare them, apart from the module that rules and their SQL are generated from."""
    assert set(PRIMARY_KEYS.items()) == {
        ("coaches", "id_coach"), ("retadores", "id_retador"), ("retos", "id_reto"), ("participacion", "id_participacion"),
        ("parametros", "id_parametro"), ("registros_parametros", "id_registro_parametro"), ("fotos", "id_foto"), ("conceptos", "id_concepto"),
        ("actividades", "id_actividad"), ("registros_actividades", "id_registro_actividad"), ("habitos", "id_habito"),
        ("registros_habitos", "id_registro_habito"), ("criterios_calificacion", "id_criterio_calificacion"),
        ("registros_calificaciones", "id_registro_calificacion")}
    assert {(table, *columns) for table, columns in UNIQUE_KEYS} >= {
        ("retos", "nombre_reto"), ("participacion", "nombre_reto", "nombre_retador"), ("fotos", "id_participacion", "tipo", "estado"),
        ("registros_habitos", "id_participacion", "fecha_ocurrencia", "nombre_habito"), ("registros_actividades", "id_participacion", "id_actividad"),
        ("registros_calificaciones", "id_participacion", "criterio_calificacion", "nombre_coach"), ("registros_parametros", "id_participacion", "nombre_parametro")}
    children = Counter(rule[0] for rule in FOREIGN_KEYS)
    assert children == {"retadores": 1, "participacion": 2, "registros_parametros": 2, "fotos": 2, "actividades": 2, "registros_actividades": 4,
                        "registros_habitos": 4, "registros_calificaciones": 4}


def test_every_label_is_listed(spark):
    rows = {(r.variable, r.valor): (r.orden, r.usos) for r in views.domain_values(base(spark)).collect()}
    assert len(rows) == 18 and rows["permisos_coach", "Inactivo"] == (3, 1) and rows["tipo_foto", "Perfil"] == (2, 0)
    odd = base(spark, retadores=frame(spark, "retadores", [(1, "a", None, "Otro", "1", None, "c")]))
    assert {(r.valor, r.orden, r.usos) for r in views.domain_values(odd).filter("variable = 'sexos'").collect()} == {
        ("Mujer", 1, 0), ("Hombre", 2, 0), ("Otro", None, 1)}


def test_delete_blocked(spark):
    t = base(spark)
    assert {(r.tabla, r.clave) for r in quality.delete_blocked(t, parent="retos").collect()} == {("retos", RETO)}
    assert quality.delete_blocked(t, parent="participacion").count() == 0


def test_age_examples(spark):
    people = [
        (1, "a", date(1957, 6, 13), None, "1", None, "c"), (2, "b", date(2000, 2, 29), None, "2", None, "c"),
        (3, "d", date(2001, 4, 10), None, "3", None, "c"), (4, "e", date(2000, 3, 9), None, "4", None, "c"),
        (5, "f", None, None, "5", None, "c"), (6, "g", date(2000, 1, 31), None, "6", None, "c"),
        (7, "h", date(2000, 3, 10), None, "7", None, "c")]
    t = base(spark, retadores=frame(spark, "retadores", people))
    got = {r.id_retador: (r.anios, r.meses, r.dias, r.edad) for r in views.challenger_age(t, as_of=date(2001, 4, 10)).collect()}
    assert got[1] == (43, 9, 27, "43 Años 9 Meses 27 Días")
    assert got[3] == (0, 0, 0, "00:00:00")
    assert got[4] == (1, 1, 1, "1 Años 1 Mes 1 day")
    assert got[5] == (None, None, None, None)
    assert got[7] == (1, 1, 0, "1 Años 1 Mes")
