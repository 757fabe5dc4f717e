"""Batches whose rows exclude each other, against the same choice made row by row; deletions and renames through the graph of keys."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablero.operators.admission import first_free, independent_groups
from tablero.operators.stored import shared_folder
from tablero.plans import keys, quality, saving
from tests.frames import ANA, COACHES, END, HABITS, LUIS, RETO, START, activity, attendance, base, frame, habit_rows, ratings

DAY = datetime(2024, 1, 1)
BATCH = "actividad string, inicio timestamp_ntz, fin timestamp_ntz, nombre_reto string, tema_actividad string, coach_expositor string"


@pytest.mark.parametrize("seed", [1, 2])
def test_first_free_follows_the_line(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(400):
        group, start = ("g" if rng.random() < 0.8 else rng.choice("ab")), DAY + timedelta(minutes=rng.randrange(0, 30_000, 7))
        rows.setdefault((group, start), start + timedelta(minutes=rng.choice([0, 0, 5, 60, 400])))
    want, last = set(), {}
    for (group, start), end in sorted(rows.items()):
        if group not in last or start > last[group]:
            want.add((group, start))
            last[group] = end
    df = spark.createDataFrame([(g, s, e) for (g, s), e in rows.items()], "g string, a timestamp_ntz, b timestamp_ntz")
    assert {(r.g, r.a) for r in first_free(df, "g", "a", "b").collect()} == want
    assert first_free(df.limit(0), "g", "a", "b").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_independent_groups_in_order(spark, seed):
    rng = random.Random(seed)
    groups = [f"g{i:03}" for i in range(60)]
    # One person is in a third of all groups, one group holds a third of all persons.
    members = {(p, g) for g in groups for p in rng.sample(range(300), rng.choice([1, 2, 3]))} | {(999, g) for g in groups[::3]} | {(p, groups[7]) for p in range(100)}
    order = {g: rng.random() for g in groups}
    taken = set(rng.sample(range(300), 20))
    want, busy = set(), set(taken)
    for g in sorted(groups, key=order.get):
        own = {p for p, h in members if h == g}
        if not own & busy:
            want.add(g)
            busy |= own
    df = spark.createDataFrame([(p, g, order[g]) for p, g in members], "p long, g string, o double")
    got = independent_groups(df, spark.createDataFrame([(p,) for p in taken], "p long"), "g", "p", "o").collect()
    assert sorted(r.g for r in got) == sorted(want) and 1 < len(want) < len(groups)


def test_save_activities_one_after_another(spark):
    held = [activity(5, "Fit Camp", DAY + timedelta(days=2, hours=10), 2)]
    t = base(spark, actividades=frame(spark, "actividades", held), retos=frame(spark, "retos", [(1, RETO, START, END, True), (2, "Viejo", START, END, False)]))
    h = timedelta(hours=1)

    def line(topic, start, hours, kind="Fit Camp", reto=RETO, coach=COACHES[0]):
        return (kind, start, None if hours is None else start + hours * h, reto, topic, coach)

    rows = {
        "a": line("a", DAY + 8 * h, 2), "b touches a": line("b", DAY + 10 * h, 1), "c after the refused b": line("c", DAY + 10.5 * h, 1),
        "d starts with c, ends later": line("d", DAY + 10.5 * h, 3), "e meets a stored one": line("e", DAY + 59 * h, 3), "f": line("f", DAY + 61 * h, 0),
        "late": line("late", DAY + timedelta(days=21), 1), "late ceremony": line("cer", DAY + timedelta(days=21), 1, "Ceremonia"),
        "last day into the next": line("over", DAY + timedelta(days=20, hours=23), 1), "idle": line("idle", DAY + 8 * h, 1, reto="Viejo"),
        "nowhere": line("no", DAY + 8 * h, 1, reto="Otro", coach="Nadie"), "turned": line("turned", DAY + 12 * h, -1), "open": line("open", DAY + 12 * h, None)}
    saved = saving.save_activities(t, spark.createDataFrame(list(rows.values()), BATCH))
    assert saved.rejected.columns == [*(c.split()[0] for c in BATCH.split(", ")), "motivos"]
    assert {r.tema_actividad: r.motivos for r in saved.rejected.collect()} == {
        "b": "solapa_lote", "d": "solapa_lote", "e": "solapa_guardada", "late": "fuera_de_reto", "over": "fuera_de_reto", "idle": "reto_inactivo",
        "no": "reto_desconocido,coach_desconocido", "turned": "tiempo_invalido", "open": "tiempo_invalido"}
    table = saved.table.collect()
    assert sorted(r.tema_actividad for r in table) == ["Tema", "a", "c", "cer", "f"] and sorted(r.id_actividad for r in table) == [5, 6, 7, 8, 9]
    after = t.replace(actividades=saved.table)
    assert quality.dq_activity_overlap(after).count() == quality.dq_activity_range(after).count() == quality.dq_inactive(after, tables=("actividades",)).count() == 0
    again = saving.save_activities(after, spark.createDataFrame([rows["a"]] * 2, BATCH))
    assert again.table.count() == 5 and [r.motivos for r in again.rejected.collect()] == ["solapa_guardada"] * 2
    twice = saving.save_activities(t, spark.createDataFrame([rows["a"]] * 3, BATCH))
    assert twice.table.count() == 2 and [r.motivos for r in twice.rejected.collect()] == ["solapa_lote"] * 2
    assert saving.save_activities(t, spark.createDataFrame([], BATCH)).table.count() == 1


def several(spark):
    """Four challenges, two of them active, and five challengers."""
    people = [(i, f"Persona {i} Abc", START, "Mujer", f"90000000{i}", None, COACHES[0]) for i in range(1, 6)]
    retos = [(1, "Uno", START, END, True), (2, "Dos", START, END, True), (3, "Tres", START, END, False), (4, "Cuatro", START, END, False)]
    enrolled = [(1, "Uno", "Persona 1 Abc", None), (2, "Tres", "Persona 1 Abc", None), (3, "Tres", "Persona 2 Abc", None), (4, "Cuatro", "Persona 2 Abc", None)]
    return base(spark, retadores=frame(spark, "retadores", people), retos=frame(spark, "retos", retos), participacion=frame(spark, "participacion", enrolled))


def test_save_enrolments(spark):
    t = several(spark)
    asked = [
        ("Uno", 1), ("Dos", 1), ("Uno", 2), ("Dos", 2), ("Tres", 3), ("Nada", 3), ("Dos", 3), ("Dos", 3), ("Uno", 9), ("Uno", 4)]
    batch = spark.createDataFrame([(r, f"Persona {p} Abc", "bajar") for r, p in asked], "nombre_reto string, nombre_retador string, objetivo_participacion string")
    saved = saving.save_enrolments(t, batch)
    refused = Counter((r.nombre_reto, int(r.nombre_retador.split()[1]), r.motivos) for r in saved.rejected.collect())
    assert refused == Counter([
        ("Uno", 1, "ya_inscrito"), ("Dos", 1, "otro_reto_activo"), ("Uno", 2, "otra_inscripcion_del_lote"), ("Tres", 3, "reto_inactivo"), ("Nada", 3, "reto_desconocido"),
        ("Dos", 3, "otra_inscripcion_del_lote"), ("Uno", 9, "retador_desconocido")])
    new = {(r.id_participacion, r.objetivo_participacion): (r.nombre_reto, r.nombre_retador) for r in saved.table.filter("id_participacion > 4").collect()}
    assert sorted(k for k, _ in new) == [5, 6, 7] and {v[0] + v[1][8] for v in new.values()} == {"Dos2", "Dos3", "Uno4"} and {g for _, g in new} == {"bajar"}
    after = t.replace(participacion=saved.table)
    assert quality.dq_multi_active(after).count() == quality.dq_shared_challengers(after).count() == 0
    other = saving.save_enrolments(t, batch.withColumn("turno", F.when(F.col("nombre_reto") == "Uno", 1).otherwise(2)), ["turno"])
    assert {r.nombre_reto for r in other.table.filter("nombre_retador = 'Persona 2 Abc' AND id_participacion > 4").collect()} == {"Uno"}
    assert saving.save_enrolments(t, batch.limit(0)).table.count() == 4


def test_activate_challenges(spark):
    t = several(spark)
    names = "nombre_reto string"
    # Tres shares a person with the active Uno; Cuatro shares one with Tres only.
    saved = saving.activate_challenges(t, spark.createDataFrame([("Tres",), ("Cuatro",), ("Uno",), ("Nada",), ("Tres",)], names))
    assert sorted((r.nombre_reto, r.motivos) for r in saved.rejected.collect()) == [("Nada", "reto_desconocido"), ("Tres", "retadores_compartidos"), ("Tres", "retadores_compartidos")]
    assert {r.nombre_reto for r in saved.table.filter("reto_activo").collect()} == {"Uno", "Dos", "Cuatro"}
    assert quality.dq_multi_active(t.replace(retos=saved.table)).count() == 0
    idle = t.replace(retos=t.retos.withColumn("reto_activo", F.lit(False)))
    both = spark.createDataFrame([("Tres", 1), ("Cuatro", 2), ("Uno", 3), ("Dos", 4)], names + ", turno int")
    first = saving.activate_challenges(idle, both, ["turno"])
    assert {r.nombre_reto for r in first.table.filter("reto_activo").collect()} == {"Tres", "Dos"}
    assert {r.nombre_reto for r in saving.activate_challenges(idle, both).table.filter("reto_activo").collect()} == {"Cuatro", "Dos", "Uno"}
    assert saving.activate_challenges(t, both.limit(0)).rejected.count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_shared_pairs(spark, block):
    retos = [(i, f"R{i:02}", START, END, i % 5 != 0) for i in range(20)]
    rng = random.Random(6)
    own = {(p, r) for p in range(30) for r in rng.sample(range(20), 3)} | {(99, r) for r in range(20)}
    rows = [(n, f"R{r:02}", f"P{p}", None) for n, (p, r) in enumerate(sorted(own))]
    t = base(spark, retos=frame(spark, "retos", retos), participacion=frame(spark, "participacion", rows))
    want = Counter((f"R{a:02}", f"R{b:02}") for p, a in own for q, b in own if p == q and a < b and a % 5 and b % 5)
    assert {(r.nombre_reto, r.otro_reto): r.compartidos for r in quality.shared_pairs(t, block=block).collect()} == want
    assert quality.shared_pairs(t, reto="R03").count() == sum("R03" in pair for pair in want)


def three_levels(spark):
    return base(
        spark, registros_habitos=frame(spark, "registros_habitos", habit_rows(1, HABITS[:2], 2) + habit_rows(2, HABITS[:1], 1, first_id=50)),
        actividades=frame(spark, "actividades", [activity(1, "Fit Camp", DAY + timedelta(hours=8), 1), activity(2, "Fit Camp", DAY + timedelta(hours=12), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1)]),
        registros_calificaciones=frame(spark, "registros_calificaciones", ratings(2, COACHES[1], [1, 1, 1])))


def test_delete_restricted_from_the_children_up(spark):
    t = three_levels(spark)

    def listed(table, *ids):
        return spark.createDataFrame([(i,) for i in ids], f"{keys.PRIMARY_KEYS[table]} long")

    logs = [r.id_registro_habito for r in t.registros_habitos.collect()]
    batch = {
        "registros_habitos": listed("registros_habitos", *logs, 777), "registros_actividades": listed("registros_actividades", 1), "participacion": listed("participacion", 1, 2),
        "retadores": listed("retadores", 1, 2), "actividades": listed("actividades", 1, 2), "retos": listed("retos", 1), "coaches": listed("coaches", 2, 3)}
    found = keys.delete_restricted(t, batch)
    assert sorted((r.tabla, r.clave, r.motivos) for r in found.rejected.collect()) == [
        ("coaches", "2", "retadores.nombre_coach,registros_calificaciones.nombre_coach"), ("participacion", "2", "registros_calificaciones.id_participacion"),
        ("retadores", "2", "participacion.nombre_retador"), ("retos", "1", "participacion.nombre_reto")]
    gone = Counter(r.tabla for r in found.deleted.collect())
    assert gone == {"registros_habitos": len(logs), "registros_actividades": 1, "participacion": 1, "retadores": 1, "actividades": 2, "coaches": 1}
    assert quality.dq_orphans(found.tables).count() == 0 and [r.id_participacion for r in found.tables.participacion.collect()] == [2]
    only = keys.delete_restricted(t, {"retadores": listed("retadores", 1, 2)})
    assert only.deleted.count() == 0 and only.rejected.count() == 2
    order = keys.children_first()
    assert all(order.index(child) < order.index(parent) for child, _, parent, _ in quality.FOREIGN_KEYS)


def test_rename_keys_reach_all_children(spark):
    t = three_levels(spark)
    steps = [
        ("retos", "nombre_reto", 1, RETO, "B"), ("retos", "nombre_reto", 2, "B", "C"), ("retos", "nombre_reto", 4, "C", "D"),
        ("retadores", "nombre_retador", 1, ANA, LUIS), ("retadores", "nombre_retador", 1, LUIS, ANA), ("coaches", "nombre_coach", 1, COACHES[0], "X"),
        ("coaches", "nombre_coach", 1, "Nadie", "Y")]
    new = keys.rename_keys(t, spark.createDataFrame(steps, "tabla string, columna string, paso int, viejo string, nuevo string"))
    assert {r.nombre_reto for table in ("retos", "participacion", "actividades") for r in new[table].collect()} == {"D"}
    assert {(r.id_participacion, r.nombre_retador) for r in new.participacion.collect()} == {(1, LUIS), (2, ANA)}
    assert {(r.id_retador, r.nombre_retador) for r in new.retadores.collect()} == {(1, LUIS), (2, ANA)}
    assert {r.coach_expositor for r in new.actividades.collect()} == {"X"} and {r.nombre_coach for r in new.registros_actividades.collect()} == {"X"}
    assert {r.nombre_coach for r in new.registros_calificaciones.collect()} == {COACHES[1]}
    assert quality.dq_orphans(new).count() == 0 and all(new[table].columns == t[table].columns for table in keys.PRIMARY_KEYS)


def test_composed_paths_of_any_length(spark):
    chain = [("t", "c", i, f"n{i}", f"n{i + 1}") for i in range(37)]
    # A name that is given before it is taken was nobody's before; one that comes back is where it was.
    back = [("t", "c", 1, "p", "q"), ("t", "c", 2, "q", "p"), ("u", "c", 3, "p", "z")]
    got = keys.composed(spark.createDataFrame(chain + back, "tabla string, columna string, paso int, viejo string, nuevo string")).collect()
    assert {(r.tabla, r.viejo): r.nuevo for r in got} == {("t", "n0"): "n37", ("t", "p"): "p", ("u", "p"): "z"}


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="compartida"):
        shared_folder(Session())
