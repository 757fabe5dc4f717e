"""Training order on disk: a keyed permutation gives every sequence its slot, ranges of slots become fixed-stride shards.

Sequences are the token pieces of the texts, each padded to ``stride`` ids. They are numbered without gaps (place inside the task that made
them plus the pieces of earlier tasks), and a Feistel network over the smallest even number of bits that holds all numbers, walked along its
cycle until it falls below their count, maps number to slot: a bijection that any task computes alone, with no sort and no
shuffle table. Slots are dealt to partitions by range, so a partition holds whole shards. A shard is ``rows`` records of ``stride`` ids;
slot s is record s % rows of shard s // rows, so a reader resumes at any slot with one seek.

The partition of a slot is computed, not sampled. The driver sees one count per input task, never a row. Ids take ``WIDTH`` bytes wherever they
are written (pieces, shuffle, shards); one that needs more stops the run. Single sequences hardly compress, so those that a task has for one partition
are packed together before they are moved (:func:`packed`).

Results for odd input: a null or empty text is one sequence with the closing id only. Repeated rows and null keys are sequences like any
others. An empty table gives no shard. Extra columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablero.llm.common import written
from tablero.llm.packing import token_pieces

STRIDE = 256
#: Bytes of an id: the vocabulary has fewer than 65,536 (another one may need 4).
WIDTH = 2
#: Records of a shard: 4 MB at the default stride and width.
ROWS = 8192
#: Fills the records: the closing text id of the vocabulary.
PAD = 49407
ROUNDS = 6
#: Bytes of sequences that a task gathers before it packs them by partition, and the level at which they are compressed.
GATHERED = 16 << 20
LEVEL = 6


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of the half word and the round key."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slots below ``count`` for numbers below ``count``: Feistel rounds on two equal halves, repeated for whatever falls outside."""
    half = np.uint64(max(1, (max(1, count - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int(mix(np.array([key + i], dtype=np.uint64), 0x5851F42D4C957F2D)[0]) for i in range(rounds)]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(count)]
    return out.astype(np.int64)


def slots(docs: DataFrame, path: str, seed: int, stride: int = STRIDE, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, int]:
    """Every token piece with its ids and its slot, and how many there are."""
    unnumbered = token_pieces(docs, path, stride, key, text, with_ids=True, width=width).drop("local")
    pieces = written(unnumbered.withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "zstd")
    made = sorted((row[0], row[1]) for row in pieces.groupBy("part").agg((F.max("nth") + 1).alias("n")).collect())
    parts, ahead = np.array([p for p, _ in made], dtype=np.int64), np.cumsum([0, *(n for _, n in made)])
    count = int(ahead[-1])

    @F.pandas_udf("long")
    def slot(part: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(permuted(ahead[np.searchsorted(parts, part.to_numpy())] + nth.to_numpy(), count, seed))

    return pieces.select(key, "piece", "start", "length", "ids_crc32", "ids", slot("part", "nth").alias("slot")), count


def packed(sequences: DataFrame, count: int, rows: int, partitions: int) -> DataFrame:
    """The sequences in packages: the number of a partition, and compressed what a task has gathered for it, with its size before."""
    total = max(1, -(-count // rows))

    def packages(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = pa.Table.from_batches(held).combine_chunks()
        of = gathered["slot"].to_numpy() // rows * partitions // total
        order = np.argsort(of, kind="stable")
        dealt, numbers = gathered.take(pa.array(order)).combine_chunks(), of[order]
        firsts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for first, end in pairwise(firsts):
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), dealt.schema) as out:
                out.write_table(dealt.slice(first, end - first))
            raw = sink.getvalue()
            yield pa.RecordBatch.from_pydict({
                "partition": pa.array([int(numbers[first])], pa.int32()), "size": [raw.size], "content": [codec.compress(raw, asbytes=True)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GATHERED:
                yield from packages(held)
                held, size = [], 0
        if held:
            yield from packages(held)

    return sequences.mapInArrow(run, "partition int, size long, content binary")


def unpacked(packages: DataFrame, schema: StructType) -> DataFrame:
    """The sequences of :func:`packed`, which had the given schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for size, content in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                with pa.ipc.open_stream(codec.decompress(content.as_buffer(), size)) as found:
                    yield from found

    return packages.mapInArrow(run, schema)


def by_range(sequences: DataFrame, count: int, rows: int, partitions: int) -> DataFrame:
    """A range of whole shards per partition, in the order of their slots. Slots are even, so the ranges are known without a sample."""
    dealt = packed(sequences, count, rows, partitions).repartitionById(partitions, "partition")
    return unpacked(dealt, sequences.schema).sortWithinPartitions("slot")


def shards(docs: DataFrame, path: str, seed: int, folder: str | None = None, stride: int = STRIDE, rows: int = ROWS, pad: int = PAD,
           key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per sequence: key, piece, start, length, ids_crc32 of its own ids, slot, shard, record, record_crc32 of the padded record (both of
    32-bit ids, whatever the width) and shard_crc32 of its shard's bytes.

    With a folder (any URI that Arrow's file systems open) each shard is written there as ``shard-<number>.bin``: first under a name of its
    own, then moved into place, so a repeated task leaves the same file. shard_crc32 is then that of the file as read back."""
    sequences, count = slots(docs, path, seed, stride, key, text, width)
    kind = sequences.schema[key].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32", "slot", "shard", "record", "record_crc32", "shard_crc32"]

    def flush(number: int, raw: bytes) -> bytes:
        files, at = fs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(draft := f"{at}/.{number}-{uuid.uuid4().hex}") as out:
            out.write(raw)
        files.move(draft, f"{at}/shard-{number:08d}.bin")
        with files.open_input_stream(f"{at}/shard-{number:08d}.bin") as data:
            return data.read()

    def finished(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a whole shard, which is written before."""
        record = np.full((sum(len(x) for x in held), stride), pad, dtype=f"<u{width}")
        for line, ids in zip(record, (x for batch in held for x in batch.column(5)), strict=True):
            own = np.frombuffer(ids.as_py(), dtype=f"<u{width}")
            line[: len(own)] = own
        raw = record.tobytes()
        whole, first = zlib.crc32(flush(number, raw) if folder else raw), 0
        for batch in held:
            slot = batch.column(6).to_numpy()
            sums = [zlib.crc32(x) for x in record[first : first + len(slot)].astype("<u4")]
            first += len(slot)
            numbers = [pa.array(x) for x in (slot, slot // rows, slot % rows, np.array(sums, dtype=np.int64), np.full(len(slot), whole, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *numbers], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, []
        for batch in batches:
            of = batch.column(6).to_numpy() // rows
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for first, end in pairwise(cuts):
                if first == end:
                    continue
                if of[first] != number:
                    if held:
                        yield from finished(number, held)
                    number, held = int(of[first]), []
                held.append(batch.slice(first, end - first))
        if held:
            yield from finished(number, held)

    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = f"key {kind}, " + ", ".join(f"{x} long" for x in names[1:])
    return by_range(sequences, count, rows, partitions).mapInArrow(run, schema).withColumnRenamed("key", key)


def read_from(folder: str, slot: int, count: int, stride: int = STRIDE, rows: int = ROWS, width: int = WIDTH) -> np.ndarray:
    """``count`` records from a slot on as 32-bit ids, by seeking: how a reader resumes."""
    files, at = fs.FileSystem.from_uri(folder)
    found, size = [], width * stride
    while count:
        number, record = divmod(slot, rows)
        own = min(count, rows - record)
        with files.open_input_file(f"{at}/shard-{number:08d}.bin") as data:
            data.seek(record * size)
            raw = data.read(own * size)
        found.append(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").reshape(-1, stride))
        if len(raw) < own * size:
            break
        slot, count = slot + own, count - own
    return np.concatenate(found) if found else np.empty((0, stride), dtype="<u4")
