from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tablero.streaming.intake import COLUMNS, accepted, compact, judged, read_habit_stream, rejected, start_intake, take_in, valid_habits
from tests.frames import ANA, AS_OF, COACHES, HABITS, RETO, START, base, frame


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def active_rows(t):
    people = t.participacion.join(t.retos.filter("reto_activo"), "nombre_reto").select("id_participacion")
    return t.registros_habitos.join(people, "id_participacion", "left_semi")


def split(t, path, parts=3):
    """The raw rows in a few files, by order of their id."""
    raw = t["raw_habitos"]
    top = raw.agg(F.max("id_registro_habito")).first()[0] + 1
    for i in range(parts):
        low, high = top * i // parts, top * (i + 1) // parts
        part = raw.filter((F.col("id_registro_habito") >= low) & (F.col("id_registro_habito") < high))
        part.coalesce(1).write.mode("append").parquet(str(path))


def test_stream_equals_batch(spark, small, tmp_path):
    split(small, tmp_path / "in")
    stream = read_habit_stream(spark, str(tmp_path / "in"), max_files=1)
    query = start_intake(small, stream, str(tmp_path / "out"), str(tmp_path / "chk"), AS_OF, once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    taken = accepted(spark, str(tmp_path / "out"))
    assert rows(taken) == rows(active_rows(small)) == rows(valid_habits(small, small["raw_habitos"], AS_OF))
    assert taken.select("lote").distinct().count() == 3
    bad = judged(small, small["raw_habitos"], AS_OF).filter("size(motivos) > 0")
    assert rows(rejected(spark, str(tmp_path / "out"))) == rows(bad)


def test_a_repeated_batch_changes_nothing(spark, small, tmp_path):
    out = str(tmp_path / "out")
    split(small, tmp_path / "in", parts=1)
    stream = read_habit_stream(spark, str(tmp_path / "in"))
    start_intake(small, stream, out, str(tmp_path / "chk"), AS_OF, once=True).awaitTermination(240)
    first = rows(accepted(spark, out)), rows(rejected(spark, out))
    take_in(small, small["raw_habitos"], 0, out, AS_OF)
    assert (rows(accepted(spark, out)), rows(rejected(spark, out))) == first
    take_in(small, small["raw_habitos"], 1, out, AS_OF)
    assert rows(accepted(spark, out)) == first[0]


def test_day_and_tables_are_taken_per_batch(spark, tmp_path):
    """Between two batches a person enrols and the day moves on."""
    tables, days = [base(spark, participacion=frame(spark, "participacion", [(1, RETO, ANA, None)]))], [START]
    source, out = tmp_path / "in", str(tmp_path / "out")
    later = START + timedelta(days=1)

    def run(number, data):
        frame(spark, "registros_habitos", data).coalesce(1).write.mode("append").parquet(str(source))
        start_intake(lambda: tables[-1], read_habit_stream(spark, str(source)), out, str(tmp_path / "chk"), lambda batch, n: days[-1], once=True).awaitTermination(240)

    run(0, [(1, 1, START, HABITS[0], "Habitos", COACHES[0], START), (2, 1, later, HABITS[0], "Habitos", COACHES[0], START), (3, 2, START, HABITS[0], "Habitos", COACHES[0], START)])
    assert [r.id_registro_habito for r in accepted(spark, out).collect()] == [1]
    assert {(r.id_registro_habito, *r.motivos) for r in rejected(spark, out).collect()} == {(2, "fecha_futura"), (3, "participacion_desconocida")}
    tables.append(base(spark))
    days.append(later)
    run(1, [(4, 1, later, HABITS[0], "Habitos", COACHES[0], later), (5, 2, START, HABITS[0], "Habitos", COACHES[0], later)])
    assert {r.id_registro_habito for r in accepted(spark, out).collect()} == {1, 4, 5}
    compact(spark, out, str(tmp_path / "new"))
    assert rows(accepted(spark, str(tmp_path / "new"))) == rows(accepted(spark, out))
    assert rows(rejected(spark, str(tmp_path / "new"))) == rows(rejected(spark, out))
    take_in(tables[-1], accepted(spark, out).select(*COLUMNS), 7, str(tmp_path / "new"), later)
    assert rows(accepted(spark, str(tmp_path / "new"))) == rows(accepted(spark, out))


def test_unknown_participation_is_set_aside(spark, small):
    row = small["raw_habitos"].limit(1).withColumn("id_participacion", F.lit(-1).cast("long"))
    assert judged(small, row, AS_OF).first().motivos == ["participacion_desconocida"]
