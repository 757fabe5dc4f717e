"""The intake that keeps state, against its batch counterpart."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tablero.streaming.intake import COLUMNS, accepted, read_habit_stream, rejected, valid_habits
from tablero.streaming.stateful import start_stateful_intake
from tests.frames import ANA, AS_OF, COACHES, END, HABITS, LUIS, RETO, START, base, frame


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def run(t, spark, tmp_path, **options):
    stream = read_habit_stream(spark, str(tmp_path / "in"), max_files=1)
    query = start_stateful_intake(t, stream, str(tmp_path / "out"), str(tmp_path / "chk"), once=True, **options)
    query.awaitTermination(300)
    assert query.exception() is None
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_many_batches_and_a_restart_equal_the_batch_result(spark, small, tmp_path):
    raw = small["raw_habitos"]
    arrival, out = F.lit(AS_OF), str(tmp_path / "out")
    for part in range(4):
        raw.filter(F.pmod(F.col("id_registro_habito"), F.lit(100)).between(part * 25, part * 25 + 24)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part == 1:
            run(small, spark, tmp_path, arrival=arrival, grace=10_000)
    run(small, spark, tmp_path, arrival=arrival, grace=10_000)
    kept = accepted(spark, out)
    assert kept.select("lote").distinct().count() == 4
    key = ["id_participacion", "fecha_ocurrencia", "nombre_habito"]
    want = valid_habits(small, raw, AS_OF)
    assert sorted(map(tuple, kept.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    # The registration kept is the first of its earliest batch.
    number = F.floor(F.pmod(F.col("id_registro_habito"), F.lit(100)) / 25)
    sound = raw.join(want.select(*key), key)
    first = sound.groupBy(*key).agg(F.min(F.struct(number, "id_registro_habito")).alias("m")).select("m.id_registro_habito")
    assert sorted(r[0] for r in first.collect()) == sorted(r.id_registro_habito for r in kept.collect())
    assert rejected(spark, out).count() > 0 and rejected(spark, out).filter("size(motivos) = 0").count() == 0


def test_state_goes_when_the_challenge_is_over(spark, tmp_path):
    other = END + timedelta(days=40)
    t = base(
        spark, retos=frame(spark, "retos", [(1, RETO, START, END, True), (2, "Reto Dos", other, other + timedelta(days=21), True)]),
        participacion=frame(spark, "participacion", [(1, RETO, ANA, None), (2, "Reto Dos", LUIS, None)]))
    out = str(tmp_path / "out")

    def send(data):
        frame(spark, "registros_habitos", data).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return run(t, spark, tmp_path, arrival=F.col("fecha_registro"), grace=5)

    def row(number, person, day, habit, arrives):
        return (number, person, day, habit, "Habitos", COACHES[0], arrives)

    days = [START + timedelta(days=d) for d in range(21)]
    sizes = send([row(100 + i, 1, d, HABITS[0], END) for i, d in enumerate(days)] + [row(99, 1, START, HABITS[0], END), row(98, 77, START, HABITS[0], END)])
    assert max(sizes) == 21
    # The same day once more: known habits leave no trace, another habit counts.
    late = END + timedelta(days=1)
    send([row(1, 1, START, HABITS[0], late), row(2, 1, START, HABITS[1], late), row(3, 1, START, HABITS[1], late)])
    found = {r.id_registro_habito for r in accepted(spark, out).collect()}
    assert found == {99, *range(101, 121), 2}
    # A later challenge moves the watermark; what comes for the old one is set aside, and its state is gone.
    sizes = send([row(4, 2, other, HABITS[0], other), row(5, 1, START, HABITS[2], other)])
    assert sizes[-1] == 1
    assert {(r.id_registro_habito, *r.motivos) for r in rejected(spark, out).collect()} == {(98, "participacion_desconocida"), (5, "reto_cerrado")}
    assert {r.id_registro_habito for r in accepted(spark, out).collect()} == found | {4}
