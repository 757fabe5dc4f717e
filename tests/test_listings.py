"""Positions of ordered tables against a plain sort, and their files."""

from __future__ import annotations

import random
from datetime import datetime

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tablero.operators.positions import by_ranges, positioned, write_in_order
from tablero.plans import listings
from tests.frames import ANA, COACHES, HABITS, LUIS, RETO, activity, attendance, base, frame, habit_rows, ratings


def test_positions_are_those_of_a_sort(spark):
    """A third of the rows share the first key; nulls, repeated values and several partitions."""
    draw = random.Random(3)
    rows = [(draw.choice(["hot", "hot", None, f"k{draw.randint(0, 40)}"]), draw.choice([None, draw.randint(0, 9)]), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = positioned(df, [F.col("k").asc_nulls_last(), F.col("v").desc_nulls_first(), F.col("id").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is not None, -(r[1] or 0), r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.posicion)] == want
    assert sorted(r.posicion for r in got) == list(range(1, 3001))


def test_a_common_value_is_no_single_range(spark):
    df = spark.range(200_000).select(F.lit("one").alias("k"), F.xxhash64("id").alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("k").asc(), F.col("id").asc()]
        found = positioned(df, order).select(F.count("*"), F.min("posicion"), F.max("posicion"), F.count_distinct("posicion")).first()
        sizes = [r["count"] for r in by_ranges(df, order).groupBy("_rango").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(found) == (200_000, 1, 200_000, 200_000)
    assert len(sizes) > 1 and max(sizes) < 100_000


def test_empty_table_and_written_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    assert positioned(df.limit(0), [F.col("v").asc()]).count() == 0
    write_in_order(positioned(df, [F.col("v").asc()]), str(tmp_path / "out"))
    files = [pq.read_table(f).to_pydict() for f in sorted((tmp_path / "out").glob("*.parquet"))]
    positions = [p for file in files for p in file["posicion"]]
    assert positions == list(range(1, 5001)) and [v for file in files for v in file["v"]] == sorted(r.v for r in df.collect())


def test_listings_follow_the_printed_order(spark, tmp_path):
    t = base(
        spark,
        registros_habitos=frame(spark, "registros_habitos", habit_rows(2, HABITS[:3], 2) + habit_rows(1, HABITS[:2], 2, first_id=100)),
        actividades=frame(spark, "actividades", [activity(1, "Fit Camp", datetime(2024, 1, 3, 10), 1), activity(2, "Fit Camp", datetime(2024, 1, 2, 10), 1)]),
        registros_actividades=frame(spark, "registros_actividades", [attendance(1, 1, 1), attendance(2, 2, 1), attendance(3, 2, 2), attendance(4, 1, 99)]),
        registros_calificaciones=frame(spark, "registros_calificaciones", ratings(2, COACHES[0], [1, 2, 3]) + ratings(1, COACHES[1], [1, 2, 3])))

    def listed(name):
        return [tuple(r)[:-1] for r in sorted(listings.LISTINGS[name](t).collect(), key=lambda r: r.posicion)]

    assert [(r[1], r[2]) for r in listed("cuenta_habitos")] == [(ANA, HABITS[0]), (ANA, HABITS[1]), (LUIS, HABITS[0]), (LUIS, HABITS[1]), (LUIS, HABITS[2])]
    # By day and challenger; an activity that is not known any more comes last.
    assert [(r[1], r[2]) for r in listed("asistencia")] == [
        ("Fit Camp 02/01/2024", LUIS), ("Fit Camp 03/01/2024", ANA), ("Fit Camp 03/01/2024", LUIS), ("NA NA", ANA)]
    rated = listed("calificaciones")
    assert [r[1] for r in rated] == [ANA] * 3 + [LUIS] * 3 and [r[3] for r in rated[:3]] == sorted(r[3] for r in rated[:3])
    assert {r[0] for r in listed("puntajes")} == {RETO}
    places = listings.write_listings(t, str(tmp_path / "listas"))
    assert {name: spark.read.parquet(path).count() for name, path in places.items()} == {name: len(listed(name)) for name in listings.LISTINGS}
