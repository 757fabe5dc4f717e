"""Best-fit packing planned on a histogram of lengths.

Texts become token pieces of at most ``capacity`` tokens (only longer texts are cut). The plan needs no text and no row: best-fit decreasing
runs over the counts per length (at most ``capacity`` numbers, the only thing that the driver sees) and books runs of equal pieces into
runs of equal sequences. Each piece then takes the slot of its rank among the pieces of its length.

Ranks come from three parts that are each small: the rank inside the task that made the piece, the number of pieces of that
length in earlier tasks (a window over one row per task and length), and the booked run that holds the sum. No task ever orders a length.

Size of the plan: a run of sequences is split only where a length runs out, so each length adds at most two runs, and a run that takes pieces
keeps less than half of its free space, so it takes pieces of at most 11 lengths at a capacity of 2048. The plan
therefore has fewer than ``3 * capacity * log2(capacity)`` bookings at any input size; it goes to the tasks with the function.

Results for odd input: a null or empty text is one piece that holds the closing id only. Repeated rows and null keys are pieces like any
others. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablero.llm.common import keyed, written
from tablero.llm.word_bpe import words

CAPACITY = 2048
#: The id that closes each document.
CLOSING = 0


def narrowed(ids: bytes, width: int) -> bytes:
    """Little-endian unsigned 32-bit integers as such of ``width`` bytes."""
    if width == 4:
        return ids
    found = np.frombuffer(ids, dtype="<u4")
    if found.max(initial=0) >= 1 << 8 * width:
        raise ValueError(f"id {found.max()} does not fit {width} bytes")
    return found.astype(f"<u{width}").tobytes()


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False, width: int = 4) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and where it was made: part (the task) and local (its rank there among the
    pieces of its length). ``with_ids`` adds the ids themselves as little-endian unsigned integers of ``width`` bytes; an id that needs
    more is an error."""
    names = ["key", "piece", "start", "length", "ids_crc32", "part", "local"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, seen = words(path), TaskContext.get().partitionId(), Counter()
        closing = CLOSING.to_bytes(4, "little")
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            kept: list[bytes] = []
            for i, value in enumerate(batch.column(1)):
                ids = memo.ids(value.as_py()) + closing
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    length = len(own) // 4
                    at.append(i)
                    rows.append((piece, start // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        kept.append(narrowed(own, width))
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 6)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(numbers[:, k]) for k in range(6))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_ids else [])], names + ["ids"] * with_ids)

    rows = keyed(docs, key, text)
    schema = f"key {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:]) + (", ids binary" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts. A booking (length, rank, sequence, each, offset) says: pieces of that length from that rank on
    lie in sequences from that one on, ``each`` of them per sequence, the first at that offset; it holds up to the next rank
    booked for the length. Sorted by length and rank."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    booked: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left, room = 0, counts[length], length
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room <= capacity:
                first, many, space = *free[room].pop(), room
            else:
                many, space = -(-left // (capacity // length)), capacity
                first, opened = opened, opened + many
            each = space // length
            took = min(left, many * each)
            full, part = divmod(took, each)
            booked.append((length, rank, first, each, capacity - space))
            rest = first + full
            if full:
                free[space - each * length].append((first, full))
            if part:
                free[space - part * length].append((rest, 1))
                rest += 1
            if rest < first + many:
                free[space].append((rest, first + many - rest))
            rank, left = rank + took, left - took
    return np.array(sorted(booked), dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """The pieces with their rank among all pieces of their length."""
    made = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = made.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return pieces.join(ahead, ["part", "length"]).withColumn("rank", F.col("local") + F.col("ahead"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = written(token_pieces(docs, path, capacity, key, text))
    counts = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}
    booked = plan(counts, capacity)
    # One sorted key for both columns: the rank stays below 2**50, a length below 2**13.
    keys, slot = (booked[:, 0] << 50) | booked[:, 1], StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    @F.pandas_udf(slot)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, order = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        own = booked[np.searchsorted(keys, (size << 50) | order, side="right") - 1]
        nth = order - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + nth // own[:, 3], "offset": own[:, 4] + nth % own[:, 3] * size})

    found = ranked(pieces).withColumn("slot", place("length", "rank"))
    return found.select(key, F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")
