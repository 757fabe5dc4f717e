"""Removal of lines that other documents hold, decided by sharded minimal perfect hashes that documents probe.

A line's key is the line without white space (the six ASCII characters) at both ends and with A-Z lower-cased. Keys of ``LEAST`` code
points or more that stand in several documents lose all their lines but those in the document with the smallest id.

1. Tasks cut their documents into blocks of about ``BLOCK`` characters. A block lists its different keys once, as 128-bit hashes, each with
   the number of the block's documents that hold it and the smallest of their ids; its documents refer to that list. Block and list are written once.
2. Per hash the counts are summed and the least id is kept (partial sums first, so a line of a third of all documents is one row per task).
   The hashes are dealt into shards of about ``SHARD``; each shard gets a minimal perfect hash (bit arrays in levels; a key's place is the
   rank of its bit), and three arrays in that order: a 32-bit fingerprint, the count, and the smallest id.
3. Blocks probe: one row per block and different key meets its shard's arrays, streamed behind them in one sorted partition. Answers come only
   for keys of several documents. They return to the block, ahead of its documents, which then drop their lines.

No line is joined with another, no block or shard grows with how common a line is, and nothing is capped. Keys count as equal if their
128-bit hashes are. An index may be probed by documents it was not built from; a key that it does not hold then passes for one with probability 2^-32.

Results for odd input: a null or empty text is one empty line. Very long texts are blocks of their own. Rows that repeat an id are one
document: none of them takes lines from another. Rows with a null id are one document that comes after all others. An empty table gives an empty
result. Ties cannot occur. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablero.llm.common import keyed, written
from tablero.llm.jaccard_join import mixed

#: Code points of a key that counts; characters of a block; keys of a shard.
LEAST, BLOCK, SHARD = 10, 1 << 18, 1 << 14
BLANKS = " \t\n\v\f\r"
#: Bits of a level per key that is left.
GAMMA = 2
_draw = np.random.default_rng(59)
LEVEL_SEEDS = _draw.integers(0, 2**63, (128, 2), dtype=np.uint64)


def line_key(line: str, least: int = LEAST) -> bytes | None:
    """The key of a line, None where it is too short to count. Lower-casing bytes touches A-Z only."""
    own = line.strip(BLANKS)
    return own.encode().lower() if len(own) >= least else None


class PerfectHash:
    """A minimal perfect hash of different pairs of 64-bit numbers: keys that are alone in their slot of a level stay there, the rest go on."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits) - bits

    @staticmethod
    def slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        one, two = LEVEL_SEEDS[level]
        return ((mixed(h1 + one) ^ mixed(h2 + two)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            if len(sizes) == len(LEVEL_SEEDS):
                raise ValueError("a pair is listed twice")
            size = max(64, GAMMA * len(h1))
            at = cls.slots(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """From 0 to the number of keys; -1 where no level holds a bit (certainly no key)."""
        found, left, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = base + self.slots(h1[left], h2[left], level, size)
            here = self.bits[at]
            found[left[here]] = self.ranks[at[here]]
            left, base = left[~here], base + size
        return found

    def packed(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        own = np.frombuffer(sizes, dtype=np.int64)
        return cls(own, np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=int(own.sum())).astype(bool))


def blocks(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Written once: per block a row for each different key (h1, h2, n, owner at its slot) and one for each document (key, text, slots)."""
    rows = keyed(docs, key, text)
    kind = rows.schema[0].dataType
    k = to_arrow_type(kind)
    fields = [("block", pa.int64()), ("slot", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("owner", k), ("key", k), ("text", pa.string()), ("slots", pa.binary())]
    schema = pa.schema(fields)

    def flushed(block: int, places: dict[bytes, int], counts: list, owners: list, own: list) -> Iterator[pa.RecordBatch]:
        lines, size = len(places), len(own)
        hashes = np.frombuffer(b"".join(places), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array([block] * lines, pa.int64()), pa.array(range(lines), pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(counts, pa.int64()), pa.array(owners, k),
            pa.nulls(lines, k), pa.nulls(lines, pa.string()), pa.nulls(lines, pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([
            pa.array([block] * size, pa.int64()), *(pa.nulls(size, t) for _, t in fields[1:6]),
            pa.array([x[0] for x in own], k), pa.array([x[1] for x in own], pa.string()), pa.array([x[2] for x in own], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        block = TaskContext.get().partitionId() << 32
        places: dict[bytes, int] = {}
        counts: list[int] = []
        owners: list = []
        own: list[tuple] = []
        size = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = value.as_py()
                slots = []
                for line in whole.split("\n"):
                    found = line_key(line, least)
                    slots.append(-1 if found is None else places.setdefault(xxhash.xxh3_128_digest(found), len(places)))
                for slot in set(slots) - {-1}:
                    if slot >= len(counts):
                        grown = len(places) - len(counts)
                        counts += [0] * grown
                        owners += [None] * grown
                    counts[slot] += 1
                    if name is not None and (owners[slot] is None or name < owners[slot]):
                        owners[slot] = name
                own.append((name, whole, np.array(slots, dtype=np.int32).tobytes()))
                size += len(whole) + 64
                if size >= BLOCK:
                    yield from flushed(block, places, counts, owners, own)
                    block, places, counts, owners, own, size = block + 1, {}, [], [], [], 0
        if own:
            yield from flushed(block, places, counts, owners, own)

    name = kind.simpleString()
    return written(rows.mapInArrow(run, f"block long, slot int, h1 long, h2 long, n long, owner {name}, key {name}, text string, slots binary"), "zstd")


def index(lines: DataFrame) -> tuple[DataFrame, int]:
    """From rows (h1, h2, n, owner) the written shards, and how many there are. Per shard: sizes and bits of its perfect hash, prints, counts, owners."""
    summed = written(lines.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("owner").alias("owner")))
    shards = max(1, -(-summed.count() // SHARD))
    kind = summed.schema["owner"].dataType
    k = to_arrow_type(kind)

    def built(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in (1, 2))
        own = PerfectHash.of(h1, h2)
        order = np.argsort(own.places(h1, h2))
        counts = table.column(3).to_numpy()[order]
        owners = table.column(4).take(pa.array(order)).combine_chunks()
        listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), owners)
        sizes, bits = own.packed()
        binary = [pa.array([x], pa.binary()) for x in (sizes, bits, h2[order].astype(np.uint32).tobytes(), counts.astype(np.int64).tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *binary, listed], ["shard", "sizes", "bits", "prints", "counts", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if parts and shard[start] != now:
                    yield built(now, parts)
                    parts = []
                now = int(shard[start])
                parts.append(batch.slice(start, end - start))
        if parts:
            yield built(now, parts)

    dealt = summed.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "n", "owner").repartition("shard").sortWithinPartitions("shard")
    schema = f"shard long, sizes binary, bits binary, prints binary, counts binary, owners array<{kind.simpleString()}>"
    return written(dealt.mapInArrow(run, schema)), shards


def answered(probes: DataFrame, shards: DataFrame, count: int) -> DataFrame:
    """(block, slot, owner) of the probes (block, slot, h1, h2) whose key stands in several documents and has an owner."""
    kind = shards.schema["owners"].dataType.elementType
    k = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None
        for batch in batches:
            shard, is_probe = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard) | np.diff(is_probe)) + 1).tolist(), len(shard)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if not is_probe[start]:
                    sizes, bits, prints, counts = (batch.column(c)[start].as_py() for c in (6, 7, 8, 9))
                    own, now = PerfectHash.unpacked(sizes, bits), shard[start]
                    prints, counts = np.frombuffer(prints, dtype=np.uint32), np.frombuffer(counts, dtype=np.int64)
                    owners = batch.column(10)[start].values
                    continue
                if now != shard[start]:
                    continue  # no key of this shard is indexed
                part = batch.slice(start, end - start)
                h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in (4, 5))
                at = own.places(h1, h2)
                hit = np.flatnonzero(at >= 0)
                at = at[hit]
                right = (prints[at] == h2[hit].astype(np.uint32)) & (counts[at] > 1)
                hit, at = pa.array(hit[right]), pa.array(at[right])
                yield pa.RecordBatch.from_arrays([part.column(2).take(hit), part.column(3).take(hit), owners.take(at)], schema=pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("owner", k)]))

    name = kind.simpleString()
    columns = {"kind": "int", "block": "long", "slot": "int", "h1": "long", "h2": "long", "sizes": "binary", "bits": "binary", "prints": "binary", "counts": "binary", "owners": f"array<{name}>"}
    arrays = shards.withColumn("kind", F.lit(0))
    asked = probes.withColumns({"shard": F.pmod("h1", F.lit(count)), "kind": F.lit(1)})
    both = arrays.unionByName(asked, allowMissingColumns=True).select("shard", *(F.col(c).cast(t) for c, t in columns.items()))
    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, f"block long, slot int, owner {name}").where("owner IS NOT NULL")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per document n_lines, n_dropped and the kept text."""
    found = blocks(docs, key, text, least)
    lines = found.where("slot IS NOT NULL").select("block", "slot", "h1", "h2", "n", "owner")
    shards, count = index(lines)
    answers = answered(lines.select("block", "slot", "h1", "h2"), shards, count)
    kind = found.schema["key"].dataType
    k = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owner_of = None, {}
        for batch in batches:
            names, sizes, gone, kept = [], [], [], []
            for block, slot, owner, name, whole, slots in zip(*(batch.column(c) for c in range(6)), strict=True):
                if block != now:
                    now, owner_of = block, {}
                if slot.is_valid:
                    owner_of[slot.as_py()] = owner.as_py()
                    continue
                own, name, value = np.frombuffer(slots.as_py(), dtype=np.int32).tolist(), name.as_py(), whole.as_py()
                dropped = [s in owner_of and owner_of[s] != name for s in own]
                names.append(name)
                sizes.append(len(own))
                gone.append(sum(dropped))
                kept.append("\n".join(x for x, d in zip(value.split("\n"), dropped, strict=True) if not d) if gone[-1] else value)
            yield pa.RecordBatch.from_arrays([pa.array(names, k), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["key", "n_lines", "n_dropped", "kept"])

    own = found.where("slots IS NOT NULL").select("block", "key", "text", "slots")
    both = answers.unionByName(own, allowMissingColumns=True).select("block", "slot", "owner", "key", "text", "slots")
    ordered = both.repartition("block").sortWithinPartitions("block", F.col("slot").asc_nulls_last())
    out = ordered.mapInArrow(run, f"key {kind.simpleString()}, n_lines long, n_dropped long, kept string")
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document n_lines, n_dropped and the digest of the kept lines."""
    return cleaned(docs, key, text).select(key, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
keys AS (SELECT doc_id, pos, line, length(own) AS size, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own FROM lines),
owners AS (SELECT own, min(doc_id) AS owner FROM keys WHERE size >= 10 GROUP BY own HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keys k LEFT JOIN owners o ON k.size >= 10 AND k.own = o.own)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
