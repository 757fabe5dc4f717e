"""Byte-level BPE: encoding and decoding with a local rank file.

Each task holds one encoder, built from the rank file that every executor has at the same path. Long texts are cut where the split pattern
can never match across: between a letter or digit and a blank that another letter follows. Each part then encodes as it would
inside the whole text, and a text of any length needs memory for one part and for its ids only.

Results for odd input: a null or empty text has no ids, and both digests are those of no bytes. A text without any safe cut is
encoded in one part. Repeated rows and null keys give one result row each. Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tablero.llm.common import keyed

RANKS = "byte_bpe_50k.tiktoken"
#: Parts of a long text have about this many characters.
PART = 1 << 16
CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The encoder of a rank file (one token in base64 and its rank per line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in order, cut at safe places only; each part is as long as ``size`` or runs on to the next safe place."""
    start = 0
    while len(text) - start > size:
        found = CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str, path: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """The ids of one text as little-endian unsigned 32-bit integers."""
    of = encoder(path, pattern).encode_ordinary
    found = [np.array(of(part), dtype="<u4") for part in parts(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def decode(ids: np.ndarray, path: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8."""
    return encoder(path, pattern).decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Key and ``ids`` (array of int) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(x, path, pattern).astype("<i4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = keyed(docs, key, text)
    return rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per text the number of ids, the digest of the ids and the digest of the bytes they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for value in batch.column(1):
                ids = encode(value.as_py(), path, pattern)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = keyed(docs, key, text)
    schema = f"key {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
