"""Exact distributed operators against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablero.operators.catalogue import per_catalogue_row
from tablero.operators.overlap import overlap_counts, overlap_witness
from tablero.operators.running import number_rows, running_best, running_sums, value_ranks
from tablero.operators.spread import spread_join

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
EPOCH = datetime(2024, 1, 1)


def intervals(n: int, seed: int) -> list[tuple]:
    """Many intervals, most of them in one group and often touching."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "grande" if rng.random() < 0.7 else rng.choice("abc")
        start = EPOCH + timedelta(minutes=rng.randrange(0, 4000, 30))
        rows.append((i, group, start, start + timedelta(minutes=rng.choice([0, 30, 60, 90, 1500]))))
    return rows


@FEW
@given(st.integers(1, 120), st.integers(0, 10_000))
def test_overlap_counts(spark, n, seed):
    rows = intervals(n, seed)
    df = spark.createDataFrame(rows, "id long, g string, a timestamp_ntz, b timestamp_ntz")
    want = {
        i: sum(1 for j, h, c, d in rows if h == g and j != i and a <= d and c <= b) for i, g, a, b in rows}
    assert {r.id: r.solapes for r in overlap_counts(df, "g", "a", "b").collect()} == want


def test_overlap_leaves_out_rows_without_interval(spark):
    rows = [(1, "g", EPOCH, EPOCH), (2, "g", EPOCH + timedelta(hours=1), EPOCH), (3, "g", None, EPOCH), (4, None, EPOCH, EPOCH)]
    df = spark.createDataFrame(rows, "id long, g string, a timestamp_ntz, b timestamp_ntz")
    assert [(r.id, r.solapes) for r in overlap_counts(df, "g", "a", "b").collect()] == [(1, 0)]


@FEW
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(-30, 30)), min_size=1, max_size=80), st.sampled_from([1, 7, 1000]), st.booleans())
def test_value_ranks(spark, rows, width, descending):
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r.g, r.v): (r.puesto, r.denso) for r in value_ranks(df, ["g"], "v", width, descending).collect()}

    def before(a, b):
        return a > b if descending else a < b

    want = {
        (g, v): (1 + sum(1 for h, w in rows if h == g and before(w, v)), 1 + len({w for h, w in rows if h == g and before(w, v)}))
        for g, v in rows}
    assert got == want


def test_ranks_without_groups(spark):
    df = spark.createDataFrame([(v,) for v in (5, 70_000, 5, 9_000_000)], "v long")
    assert {r.v: r.denso for r in value_ranks(df, [], "v", 65_536).collect()} == {5: 1, 70_000: 2, 9_000_000: 3}


def test_running_sums_cross_buckets(spark):
    df = spark.createDataFrame([("g", i, 1) for i in range(100)], "g string, v long, n long")
    got = running_sums(df, ["g"], "v", F.floor(F.col("v") / 9), ["n"]).collect()
    assert all(r.n_antes == r.v for r in got)


def test_number_rows_is_dense_and_stable(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(5000)], "a long, b string")
    one = number_rows(df, ["a", "b"], "id", F.lit(100)).collect()
    assert sorted(r.id for r in one) == list(range(101, 5101))
    again = number_rows(df.repartition(7), ["a", "b"], "id", F.lit(100)).collect()
    assert {(r.a, r.id) for r in one} == {(r.a, r.id) for r in again}


def test_catalogue_rows(spark):
    left = spark.createDataFrame([(i,) for i in range(40)], "id long")
    catalogue = spark.createDataFrame([(f"h{i}", i) for i in range(1500)], "h string, n int")
    one, other = per_catalogue_row(left, catalogue), per_catalogue_row(left, catalogue, slots=3)
    assert one.columns == other.columns == ["id", "h", "n"]
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))
    assert one.distinct().count() == 60_000
    plan = other._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert per_catalogue_row(left, catalogue.limit(0)).count() == 0


def test_running_sums_at_several_levels(spark):
    points = spark.createDataFrame([("g", i * i % 1009, 1) for i in range(500)], "g string, x long, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))
    for descending in (False, True):
        flat = running_sums(points, ["g"], "x", F.floor(F.col("x") / 3), ["n"], descending)
        deep = running_sums(points, ["g"], "x", F.floor(F.col("x") / 3), ["n"], descending, coarser=(5, 4))
        assert Counter(map(tuple, flat.collect())) == Counter(map(tuple, deep.collect()))


def test_spread_join_equals_join(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(90)] + [("z", 99)], "k string, v long")
    keys = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, n int")
    for how in ("inner", "left"):
        got = Counter(map(tuple, spread_join(rows, keys, ["k"], ["v"], how).select("k", "v", "n").collect()))
        assert got == Counter(map(tuple, rows.join(keys, "k", how).select("k", "v", "n").collect()))


@FEW
@given(st.integers(1, 120), st.integers(0, 10_000))
def test_overlap_among_others(spark, n, seed):
    rows, others = intervals(n, seed), intervals(60, seed + 1)
    schema = "id long, g string, a timestamp_ntz, b timestamp_ntz"
    want = {i: sum(1 for _, h, c, d in others if h == g and a <= d and c <= b) for i, g, a, b in rows}
    got = overlap_counts(spark.createDataFrame(rows, schema), "g", "a", "b", among=spark.createDataFrame(others, schema))
    assert {r.id: r.solapes for r in got.collect()} == want


@FEW
@given(st.integers(1, 120), st.integers(0, 10_000))
def test_overlap_witness(spark, n, seed):
    rows = intervals(n, seed)
    df = spark.createDataFrame(rows, "id long, g string, a timestamp_ntz, b timestamp_ntz")
    found = {r.id: r.testigo for r in overlap_witness(df, "g", "a", "b", "id").collect()}
    by_id = {i: (g, a, b) for i, g, a, b in rows}
    meets = {i: {j for j, h, c, d in rows if h == g and j != i and a <= d and c <= b} for i, g, a, b in rows}
    assert set(found) == {i for i in meets if meets[i]}
    assert all(w in meets[i] for i, w in found.items())
    same = {i: [j for j in meets[i] if by_id[j][1] == by_id[i][1]] for i in found}
    least = {i: min([*s, i]) for i, s in same.items()}
    assert all(found[i] == (least[i] if least[i] != i else max(s)) for i, s in same.items() if s)


def test_running_best_names_the_holder(spark):
    rows = [("g", i, (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v long, x long, who long").withColumn("s", F.struct("x", "who"))
    for descending in (False, True):
        line = running_best(df, ["g"], "v", F.floor(F.col("v") / 10), "s", (4, 2), descending)
        got = {r.v: r.s_antes and tuple(r.s_antes) for r in line.collect()}
        before = {v: [(x, w) for _, u, x, w in rows if (u > v if descending else u < v)] for _, v, _, _ in rows}
        assert got == {v: min(b) if b else None for v, b in before.items()}
