"""Exact top-k search on a pivot-distance index.

Integer vectors (components floor(scale * x)) are searched for the largest inner products. Each vector gets one more coordinate, the root of
(largest squared norm - own squared norm); then all lie on one sphere, queries get 0 there, and a larger inner product is a smaller
Euclidean distance. Pivots are chosen from a bounded sample. A vector belongs to its nearest pivot and is keyed by (pivot, distance);
range partitions sorted by that key are cut into annuli, runs of one pivot with an inner and an outer radius. Every row is indexed.

A query visits annuli in the order of the distance that the triangle inequality allows them, max(0, d(q, p) - outer, inner - d(q, p)). First
come its nearest ones, until they hold k candidates; their k-th score is a bound that only rises. Each round expands to the next ones and
drops all whose allowed distance cannot reach the bound; the last round visits all that are left. So the result is exact with any pivots.

Bounds: there are at most ``ANNULI`` annuli besides one per pivot and partition, so that their list (five numbers each) fits every task at any
size; their rows are held in blocks of about ``BLOCK``, and queries in blocks of that size too. A visit is an equi-join on annulus and blocks,
one matrix product, and at most k rows per query go on. Many equal vectors share one distance; annuli are cut by count, so they fill
several of them.

Results for odd input: a vector that is null, empty, or holds a null or non-finite component takes no part, as query or candidate, nor does a row
without id. Shorter vectors are filled with zeros. Rows with the query's id are no candidates for it; of repeated query ids the smallest
vector asks. Repeated candidates count each. Ties go to the smaller id. Components beyond 2**62 after scaling are clipped to that, scores to the range of a
long. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablero.llm.common import sampled, written

#: Vectors that the choice of pivots sees at most, and pivots at most.
SAMPLE, PIVOTS = 4096, 64
ANNULI, BLOCK = 65_536, 2048
#: Annuli that each round adds per query before the last takes all that are left.
ROUNDS = (0, 12)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows."""
    size = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if size < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if size < 2**63:
        return left @ right.T
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def matrix(raw, width: int) -> np.ndarray:
    """Rows of little-endian 64-bit components, filled up with zeros."""
    out = np.zeros((len(raw), width), dtype=np.int64)
    for i, x in enumerate(raw):
        own = np.frombuffer(x, dtype="<i8")
        out[i, : len(own)] = own
    return out


def integers(rows: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """Id and vec (components floor(scale * x) as bytes) of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vecs = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                if x and None not in x:
                    own = np.array(x, dtype=np.float64)
                    if np.isfinite(own).all():
                        keep.append(i)
                        with np.errstate(over="ignore"):
                            vecs.append(np.clip(np.floor(own * scale), -(2.0**62), 2.0**62).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(vecs, pa.binary())], ["id", "vec"])

    whole = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    return whole.mapInArrow(run, "id long, vec binary")


class Space:
    """Vectors on the common sphere, and the pivots on it."""

    def __init__(self, pivots: np.ndarray, largest: float):
        self.width, self.largest = pivots.shape[1], largest
        self.pivots = pivots.astype(np.float64)
        self.lift = np.sqrt(np.maximum(0, largest - (self.pivots**2).sum(1)))

    def distances(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """From each row to each pivot; a query has 0 as its further coordinate."""
        own = vectors.astype(np.float64)
        square = (own**2).sum(1)
        lift = np.zeros(len(own)) if query else np.sqrt(np.maximum(0, self.largest - square))
        length = square if query else np.full(len(own), self.largest)
        squared = length[:, None] + self.largest - 2 * (own @ self.pivots.T + lift[:, None] * self.lift[None, :])
        return np.sqrt(np.maximum(0, squared))


def choose(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots by farthest-first traversal with two passes of averaging; rounded to integers."""
    points = sample.astype(np.float64)
    chosen, gap = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres = points[chosen]
    for _ in range(2):
        nearest = ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)
        centres = np.array([points[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
    return np.rint(centres).astype(np.int64)


def index(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, Space, pd.DataFrame] | None:
    """The written index (id, vec, annulus, block), its space, and the list of annuli (annulus, pivot, inner, outer, n)."""
    width, count = vectors.agg(F.max(F.length("vec") / 8), F.count("*")).first()
    if not count:
        return None
    width = int(width)

    @F.pandas_udf("double")
    def squared(vec: pd.Series) -> pd.Series:
        return pd.Series((matrix(vec, width).astype(np.float64) ** 2).sum(1))

    some = sampled(vectors, sample, "id", "vec").collect()
    largest = vectors.agg(F.max(squared("vec"))).first()[0]
    space = Space(choose(matrix([row.vec for row in some], width), pivots), largest)

    @F.pandas_udf("pivot int, distance double")
    def place(vec: pd.Series) -> pd.DataFrame:
        away = space.distances(matrix(vec, width), query=False)
        return pd.DataFrame({"pivot": away.argmin(1).astype(np.int32), "distance": away.min(1)})

    room = max(BLOCK, -(-count // ANNULI))
    blocks = -(-room // BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            ids, annuli = batch.column(0).to_numpy(), []
            for pivot in batch.column(2).to_pylist():
                if pivot != now or held == room:
                    number, now, held = number + 1, pivot, 0
                held += 1
                annuli.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(annuli, pa.int64()), pa.array((ids % blocks).astype(np.int32))], [*batch.schema.names, "annulus", "block"])

    keyed = vectors.withColumn("at", place("vec")).select("id", "vec", "at.pivot", "at.distance")
    ordered = keyed.repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    rows = written(ordered.mapInArrow(cut, "id long, vec binary, pivot int, distance double, annulus long, block int"))
    annuli = rows.groupBy("annulus").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count("*").alias("n"))
    return rows.drop("pivot", "distance"), space, annuli.toPandas().sort_values("annulus").reset_index(drop=True)


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) per query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, asks: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding",
           pivots: int = PIVOTS, sample: int = SAMPLE, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """The k candidates with the largest inner products for each row that ``asks`` (a condition on ``id``) selects."""
    vectors = written(integers(rows, scale, key, vector))
    built = index(vectors, pivots, sample)
    if built is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data, space, annuli = built
    width, blocks = space.width, -(-max(BLOCK, -(-int(annuli.n.sum()) // ANNULI)) // BLOCK)
    numbers, pivot, inner, outer, held = (annuli[c].to_numpy() for c in ("annulus", "pivot", "inner", "outer", "n"))
    queries = vectors.where(asks).groupBy("id").agg(F.min("vec").alias("vec"))
    parts = max(1, -(-queries.count() // BLOCK))
    queries = written(queries.select(F.col("id").alias("query_id"), "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")))

    def visits(step: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vecs = matrix(batch.vec, width)
                away = space.distances(vecs, query=True)[:, pivot]
                allowed = np.maximum(0, np.maximum(away - outer, inner - away))
                # An inner product is (|q|^2 + largest - distance^2) / 2; one more covers the rounding of floating point.
                reach = ((vecs.astype(np.float64) ** 2).sum(1)[:, None] + space.largest - allowed**2) / 2
                reach += 1 + 1e-9 * (np.abs(reach) + space.largest)
                out = []
                for i in range(len(batch)):
                    order = np.argsort(allowed[i], kind="stable")
                    first = int(np.searchsorted(np.cumsum(held[order]), k + 1)) + 1
                    start = 0 if step == 0 else first + sum(rounds[:step])
                    stop = first if step == 0 else None if step == len(rounds) else first + sum(rounds[: step + 1])
                    own = order[start:stop]
                    if step and pd.notna(batch.bound.iloc[i]):
                        own = own[reach[i, own] >= batch.bound.iloc[i]]
                    out.append(pd.DataFrame({"annulus": numbers[own], "part": batch.part.iloc[i], "query_id": batch.query_id.iloc[i], "query": batch.vec.iloc[i]}))
                yield pd.concat(out) if out else pd.DataFrame({"annulus": [], "part": [], "query_id": [], "query": []})
        return run

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        ids, asked = right.id.to_numpy(), left.query_id.to_numpy()
        scores = product(matrix(left["query"], width), matrix(right.vec, width))
        out = []
        for i, one in enumerate(asked):
            others = np.flatnonzero(ids != one)
            order = others[np.lexsort((ids[others], ~scores[i, others]))[:k]]
            out.append(pd.DataFrame({"query_id": one, "vec_id": ids[order], "score": scores[i, order]}))
        return pd.concat(out)

    found = None
    for step in range(len(rounds) + 1):
        asked = queries.withColumn("bound", F.lit(None).cast("long"))
        if found is not None:
            bounds = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
            asked = queries.join(bounds, "query_id", "left")
        wanted = written(asked.mapInPandas(visits(step), "annulus long, part int, query_id long, query binary"))
        # A block of an annulus goes once to each block of queries that visits it.
        meets = wanted.select(F.col("annulus").alias("met"), F.col("part").alias("by")).distinct()
        near = data.join(meets, F.col("annulus") == F.col("met")).groupBy("met", "block", "by")
        each = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else wanted.withColumn("block", F.lit(0))
        scores = each.groupBy("annulus", "block", "part").cogroup(near).applyInPandas(meet, "query_id long, vec_id long, score long")
        if found is not None:
            scores = scores.unionByName(found.drop("rank"))
        found = written(best(scores, k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows by comparing every query with every vector, for tables of ids without repeats and vectors without gaps.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
