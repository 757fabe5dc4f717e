"""What keeps the plans small where tables are large: what is broadcast, sorted, and done in rounds."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablero.operators import admission, overlap
from tablero.operators.positions import by_ranges, positioned
from tablero.operators.spread import copies, estimated_size, spread_join
from tablero.operators.stored import stored, weighed
from tablero.plans import quality, saving, upkeep, views
from tests.frames import AS_OF, COACHES, CRITERIA, START, base, frame, ratings

EPOCH = datetime(2024, 1, 1)
INTERVALS = "id long, g string, a timestamp_ntz, b timestamp_ntz"


@pytest.fixture
def setting(spark):
    """Settings of the session for one test."""
    changed = []

    def put(key: str, value: str) -> None:
        changed.append((key, spark.conf.get(key)))
        spark.conf.set(key, value)

    yield put
    for key, value in reversed(changed):
        spark.conf.set(key, value)


def test_days_of_the_checklist_unfold_after_the_join(spark):
    """What is repeated, and broadcast by its estimate, has one row per challenge, not one per day."""
    t = base(spark)
    plan = views.habit_checklist(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(fecha_ini") < plan.index("Join [nombre_reto#")
    assert views.habit_checklist(t).count() == 2 * 21 * t.habitos.count()
    assert views.habit_checklist(t, fecha=START).count() == 2 * t.habitos.count()


def test_orphans_are_found_without_sorting_the_rows(spark):
    rows = [r for n in range(300) for r in ratings(n, "Coach Uno Abc", [0, 0, 0])]
    t = base(spark, registros_calificaciones=frame(spark, "registros_calificaciones", [(i, *r[1:2], "Otro" if i % 2 else r[2], *r[3:]) for i, r in enumerate(rows)]))
    found = quality.dq_orphans(t, tables=("registros_calificaciones",))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = Counter({("dq_orphans:criterio_calificacion->criterios_calificacion", "Otro"): 450})
    assert Counter((r.rule, r.detalle) for r in found.collect() if "criterio" in r.rule) == want


def test_ranges_do_not_grow_with_compression(spark, setting):
    setting("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    setting("spark.sql.shuffle.partitions", "12")
    df = spark.range(20_000).select("id", F.lit("x" * 500).alias("text"))
    sizes = [r["count"] for r in by_ranges(df, [F.col("id").asc()]).groupBy("_rango").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 4000
    assert positioned(df, [F.col("id").asc()]).filter("posicion <> id + 1").count() == 0


def chain(n: int, seed: int) -> list[tuple]:
    """Intervals of three groups with different starts in each."""
    draw, rows = random.Random(seed), []
    for g, size in (("x", n), ("y", n // 5), ("z", 2)):
        for start in draw.sample(range(4 * n), size):
            rows.append((len(rows), g, EPOCH + timedelta(minutes=start), EPOCH + timedelta(minutes=start + draw.choice([0, 1, 7, 60]))))
    return rows


def test_small_groups_are_admitted_without_rounds(spark, monkeypatch):
    rows = chain(300, 1)
    written = []
    monkeypatch.setattr(admission, "stored", lambda df, write=admission.stored: written.append(df) or write(df))
    want, until = set(), {}
    for i, g, a, b in sorted(rows, key=lambda r: r[2]):
        if g not in until or a > until[g]:
            until[g] = b
            want.add(i)
    df = spark.createDataFrame(rows, INTERVALS)
    assert {r.id for r in admission.first_free(df, "g", "a", "b").collect()} == want
    assert len(written) == 2
    assert {r.id for r in admission.first_free(df, "g", "a", "b", few=50).collect()} == want  # two groups in rounds


def test_meetings_with_small_groups_of_another_table(spark):
    rows, others = chain(120, 2), [(i, "w" if g == "z" else g, a, b) for i, g, a, b in chain(100, 3)]
    want = {i: sum(1 for _, h, c, d in others if h == g and a <= d and c <= b) for i, g, a, b in rows}
    df, among = (spark.createDataFrame(x, INTERVALS) for x in (rows, others))
    plan = overlap.overlap_counts(df, "g", "a", "b", among=among)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    for few in (0, 50, 1000):
        assert {r.id: r.solapes for r in overlap.overlap_counts(df, "g", "a", "b", among=among, few=few).collect()} == want


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_what_is_broadcast_is_not_repeated(spark, setting, how):
    rows = spark.range(3000).select("id", F.concat(F.lit("Reto "), F.col("id") % 50).alias("reto"))
    names = stored(spark.range(1, 48).select(F.concat(F.lit("Reto "), "id").alias("reto"), F.col("id").alias("n")))
    want = Counter((f"Reto {r % 50}", r, r % 50 if 0 < r % 50 < 48 else None) for r in range(3000) if how == "left" or 0 < r % 50 < 48)
    size = estimated_size(names)
    for limit, broadcast in ((size, True), (size - 1, False)):
        setting("spark.sql.autoBroadcastJoinThreshold", str(limit))
        joined = spread_join(stored(rows), names, ["reto"], ["id"], how)
        assert Counter(map(tuple, joined.collect())) == want
        assert ("BroadcastHashJoin" in plan_of(joined), "_parte" in plan_of(joined)) == (broadcast, not broadcast)


def test_copies_count_in_what_spark_measures(spark, setting):
    """A summary whose size is known only when it is there: its copies, not the summary, must be within the limit."""
    names = spark.range(40_000).select((F.col("id") % 300).alias("reto")).groupBy("reto").agg(F.count(F.lit(1)).alias("n"))
    assert estimated_size(copies(names, 32)) >= 32 * estimated_size(names)
    assert Counter(r._parte for r in copies(names, 32).collect()) == dict.fromkeys(range(32), 300)
    setting("spark.sql.autoBroadcastJoinThreshold", "30000")
    rows = spark.range(60_000).select("id", (F.col("id") % 300).alias("reto"))
    joined = spread_join(rows, names, ["reto"], ["id"])
    assert joined.count() == 60_000
    joined.collect()
    plan = plan_of(joined)
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_packed_tables_are_weighed_by_their_rows(spark, setting):
    rows = stored(spark.range(9000).select(F.col("id").alias("k"), F.lit("Coach Uno Abc").alias("nombre")), "zstd")
    log = stored(spark.range(9000).select(F.col("id").alias("k"), F.rand(1).alias("x")))
    setting("spark.sql.autoBroadcastJoinThreshold", str(2 * estimated_size(rows)))
    assert "BroadcastHashJoin" in plan_of(log.join(rows, "k", "left_semi"))
    for how in ("left_semi", "inner", "left_anti"):
        assert "BroadcastHashJoin" not in plan_of(log.join(weighed(rows).select("k"), "k", how))
    assert log.join(weighed(rows), "k").count() == 9000
    setting("spark.sql.autoBroadcastJoinThreshold", "1000000")
    assert "BroadcastHashJoin" in plan_of(log.join(weighed(rows), "k", "left_semi"))


def test_a_large_batch_is_not_broadcast_by_a_save(spark, setting, monkeypatch):
    people = range(2500)
    t = base(spark, registros_calificaciones=stored(frame(spark, "registros_calificaciones", [
        (i, *r[1:]) for i, r in enumerate(r for n in people for r in ratings(n, COACHES[n % 2], [0, 1, 2]))])))
    batch = spark.createDataFrame(
        [(n, COACHES[0], c, "Igual") for n in people for c in CRITERIA], "id_participacion long, nombre_coach string, criterio_calificacion string, calificacion string")
    setting("spark.sql.autoBroadcastJoinThreshold", "60000")
    plans = []
    monkeypatch.setattr(upkeep, "stored", lambda df, *a: plans.append(plan_of(df)) or stored(df, *a))
    change = upkeep.saved_deltas(t, {"registros_calificaciones": (batch, lambda part, rows: saving.save_ratings(part, rows, AS_OF))})
    assert change.count() == 2  # the two who are enrolled
    big = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin [id_participacion" in line]
    assert len(plans) == 4 and not big
