"""Similarity join of texts: Jaccard of five-word shingles, candidates pruned by Bayes, the rest verified exactly.

1. Each text becomes its set of shingle hashes (64 bits), a MinHash signature and a digest of the set. Texts with equal sets are one class of
   copies from here on: one representative and a count, however many there are.
2. Representatives meet in the bands of their signatures. Inside a band bucket pairs are compared a stretch of MinHash values at a
   time; with m of n values equal and a uniform prior, the posterior probability that the similarity reaches the threshold is
   P(Binomial(n + 1, threshold) <= m), and the pair is dropped once that falls below the tolerance. What survives joins the two
   in a candidate group; only spanning edges leave a task, never pairs.
3. Inside a candidate group all pairs are pruned in the same way and the rest is verified on the shingle sets. Links are counted
   per representative, weighted by copies, and the verified links give the classes.

Buckets and groups of any size are dealt as pairs of blocks of at most ``BLOCK`` representatives, so no task holds more than two blocks.
The work inside a group of near copies with different texts stays quadratic, as its number of links is.

Chance: a pair at the threshold shares no band with probability (1 - t**ROWS)**BANDS = 3e-6 at 0.8, and is pruned with about the tolerance per
stretch; both fall fast above it. Verification is exact up to collisions of 64-bit shingle hashes within a pair.

Results for odd input: a text of one to four words is one shingle; a null, empty or wordless text has no shingles, no link and is its own class. A row with a
null id is likewise its own class (null) without links. Repeated rows are copies of each other. An empty table gives an empty result. Extra
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.llm.common import keyed, words_of, written
from tablero.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STRETCH = 24, 4, 16
TOLERANCE = 1e-6
#: Representatives of a block.
BLOCK = 512
_draw = np.random.default_rng(20_240_125)
FACTORS = (_draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SHIFTS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
SPREAD = (_draw.integers(0, 2**63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class WordHashes(dict):
    """Word to its 64-bit hash; emptied when it has met 200,000 words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, memo: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for j in range(size):
        total += mixed(hashes[j : j + count] + SPREAD[j]) * SPREAD[j]
    return np.unique(mixed(total))


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each)."""
    out = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for first in range(0, len(sets), 4096):
        values = sets[None, first : first + 4096] * FACTORS[:, None] + SHIFTS[:, None]
        out = np.minimum(out, values.min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=8)
def least_equal(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the equal ones below which a pair is dropped."""
    out = {}
    for n in range(STRETCH, BANDS * ROWS + 1, STRETCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def survivors(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (as indices into the signatures) that no stretch drops."""
    equal = np.zeros(len(left), dtype=np.int32)
    for n, least in least_equal(threshold, tolerance).items():
        equal += (sigs[left, n - STRETCH : n] == sigs[right, n - STRETCH : n]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        left, right, equal = left[keep], right[keep], equal[keep]
    return left, right


def labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected to."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal first columns, across batches; the rows come sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        names = list(rows.columns[:keys])
        marks = rows[names].to_numpy()
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        if held and tuple(held[-1].iloc[-1, :keys]) != tuple(rows.iloc[0, :keys]):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            part = rows.iloc[first:last]
            if last < len(rows):
                yield pd.concat([*held, part]) if held else part
                held = []
            else:
                held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def pairs(side: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a block, or of two blocks across."""
    if not crossed:
        return np.triu_indices(len(side), 1)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(first, len(second)), np.tile(second, len(first))


def stacked(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Written once: row (a number of its own), key, digest of the shingle set (h1, h2), n shingles, sig and band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            h1, h2, sizes, sigs, bands = [], [], [], [], []
            for value in batch.column(1):
                sets = shingles(value.as_py(), memo)
                raw = sets.tobytes()
                sig = signature(sets)
                h1.append(xxhash.xxh64_intdigest(raw, 1) - 2**63)
                h2.append(xxhash.xxh64_intdigest(raw, 2) - 2**63)
                sizes.append(len(sets))
                sigs.append(sig.tobytes())
                bands.append([xxhash.xxh64_intdigest(sig[i : i + ROWS].tobytes(), i) - 2**63 for i in range(0, len(sig), ROWS)] if len(sets) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["key", "h1", "h2", "n", "sig", "bands"])

    rows = keyed(docs, key, text)
    kind = rows.schema[0].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, h1 long, h2 long, n long, sig binary, bands array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()))


def blocked(rows: DataFrame, size: Column, node: str, by: list[str], *payload: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: the group's columns, low, high (the two blocks) and side (0 or 1)."""
    count = F.ceil(size / BLOCK).cast("int")
    own = rows.withColumn("count", count).withColumn("own", F.pmod(F.xxhash64(node), F.col("count")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = other.select(*by, low.alias("low"), high.alias("high"), (F.col("own") == high).cast("int").alias("side"), node, *payload)
    return dealt.repartition(*by, "low", "high").sortWithinPartitions(*by, "low", "high")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row the id, class_id (the smallest id of the texts that links connect it with, its own without links) and n_links (texts that
    reach the threshold with it, copies included)."""
    rows = described(docs, key, text)
    usable = rows.where(F.col("key").isNotNull() & (F.col("n") > 0))
    sets = written(usable.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("key").alias("first")))
    one = usable.join(sets.select("node", "copies"), F.col("row") == F.col("node")).select("node", "copies", "key", "h1", "h2", "sig", "bands")
    representatives = written(one)

    # Band buckets with more than one representative.
    entries = representatives.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = entries.join(shared, ["band", "bucket"])
    met = met.join(representatives.select("node", "sig"), "node")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in groups(batches, 4):
            node, sigs = rows_["node"].to_numpy(), stacked(rows_["sig"], "<u4")
            crossed = rows_["low"].iloc[0] != rows_["high"].iloc[0]
            left, right = survivors(sigs, *pairs(rows_["side"].to_numpy(), crossed), threshold, tolerance)
            label = labels(len(node), left, right)
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    dealt = blocked(met, F.col("size"), "node", ["band", "bucket"], "sig")
    near = components(dealt.mapInArrow(connect, "a long, b long"))

    # The texts of candidate groups, as shingle sets.
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    wanted = written(near.join(sizes, "root").join(representatives.select("node", "copies", "key", "h1", "h2", "sig"), "node"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            keep, found = [], []
            for i, (value, h1, h2) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = shingles(value.as_py(), memo).tobytes()
                if xxhash.xxh64_intdigest(raw, 1) - 2**63 == h1 and xxhash.xxh64_intdigest(raw, 2) - 2**63 == h2:
                    keep.append(i)
                    found.append(raw)
            kept = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3, 8)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], ["node", "root", "size", "copies", "sig", "sets"])

    texts = keyed(docs, key, text).withColumnRenamed(key, "key").join(wanted, "key").select("text", "h1", "h2", "node", "root", "size", "copies", "sig")
    filled = texts.mapInArrow(sets_of, "node long, root long, size long, copies long, sig binary, sets binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in groups(batches, 3):
            rows_ = rows_.drop_duplicates(["side", "node"])
            node, copies, sigs = rows_["node"].to_numpy(), rows_["copies"].to_numpy(), stacked(rows_["sig"], "<u4")
            crossed = rows_["low"].iloc[0] != rows_["high"].iloc[0]
            left, right = survivors(sigs, *pairs(rows_["side"].to_numpy(), crossed), threshold, tolerance)
            own = [np.frombuffer(x, dtype=np.uint64) for x in rows_["sets"]]
            common = intersections(own, left, right)
            n = np.array([len(x) for x in own])
            linked = common >= threshold * (n[left] + n[right] - common) - 1e-9
            left, right = left[linked], right[linked]
            links = np.bincount(left, weights=copies[right], minlength=len(node)) + np.bincount(right, weights=copies[left], minlength=len(node))
            label = labels(len(node), left, right)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(node[label])], ["node", "links", "label"])

    verified = written(blocked(filled, F.col("size"), "node", ["root"], "copies", "sig", "sets").mapInArrow(verify, "node long, links long, label long"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    named = sets.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    smallest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    whole = named.join(smallest, "root").select("h1", "h2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = rows.where(F.col("key").isNotNull() & (F.col("n") > 0)).join(whole, ["h1", "h2"]).select("key", "class_id", "n_links")
    alone = rows.where(F.col("key").isNull() | (F.col("n") == 0)).select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone).withColumnRenamed("key", key)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs: pair by pair if few, else as products of the incidence matrix, a stretch of columns
    at a time; hashes that only one set holds need no column."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], number[column[keep]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        low, high = np.searchsorted(column, [first, first + 8192])
        part = np.zeros((len(sets), 8192), dtype=np.float32)
        part[row[low:high], column[low:high] - first] = 1
        total += part @ part.T
    return np.rint(total[left, right]).astype(np.int64)
