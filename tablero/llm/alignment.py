"""Alignment of the tokens that two tokenizers make of the same bytes, by merging their token ends along merge paths.

Tokenizer A is a byte-level BPE file and reads a blank and the text; tokenizer B is a piece model that puts the blank there itself. Both cover the
same bytes, so the two ordered lists of token ends say everything: where both end, a group closes, and each different end is one pair of overlapping
tokens (a link), namely the tokens of either side that cover the byte before it.

1. Tasks encode their documents and lay the ends of many documents one after the other. The merge of the two lists is divided along its
   diagonals: a binary search per diagonal (all at once) says how many ends of A lie before it. Pieces between diagonals have ``PIECE`` ends each,
   however long or short the documents are, and need nothing of each other but the end before them. Each emits its links and the closings of its
   groups; a group open at a piece's edge is stitched by the next closing.
2. About ``LINKS`` links make a block. It lists its different id pairs with their counts once; documents refer to that list. Block and list are written once.
3. Counts of id pairs are summed over blocks, so the pair of two commas is one row per block, not one per link. The highest count of each id of B is a table
   with at most as many rows as B has ids, and as such the only one that is broadcast.
4. The counts return to the blocks, ahead of their documents in one sorted partition, and documents add up theirs.

Nothing is capped; a block's size does not depend on how frequent a pair is. A's ids come from merging the vocabulary file's own entries with the tiktoken library, many times
faster than the tokenizers library; a test compares the two on every code point.

Results for odd input: null and empty texts, and those whose tokens do not spell a blank and the text (the sign U+2581 reads as a blank), have no tokens: zeros and
an empty string. Very long texts are blocks of their own. Repeated rows and null ids give a row each and count each. Ties for an id's highest count
all count as best. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablero.llm.common import keyed, written

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends of a piece of the merge; tokens that are laid one after the other; links of a block.
PIECE, LAID, LINKS = 1 << 14, 1 << 18, 1 << 21
#: An id pair is one number.
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers(NamedTuple):
    """Both encoders with the bytes of their tokens, and how tokens are written in groups."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    spelled: list[bytes]


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    import sentencepiece
    import tiktoken

    with open(path_a, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): number for token, number in vocabulary.items()}
    a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        bytes_a[number] = token
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    spelled = [b"%d%s" % (i, end) for ends, size in (((b",", b"|"), len(bytes_a)), ((b",", b";", b""), len(bytes_b))) for end in ends for i in range(size)]
    sizes = [np.array([len(x) for x in own], dtype=np.int64) for own in (bytes_a, bytes_b)]
    return Tokenizers(a, b, bytes_a, bytes_b, *sizes, spelled)


def encoded(text: str, own: Tokenizers) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of both sides, None where either does not spell a blank and the text."""
    if not text:
        return None
    raw = b" " + text.encode()
    a, b = own.encode_a.encode_ordinary(" " + text), own.encode_b.encode(text, num_threads=1)
    if b"".join(map(own.bytes_a.__getitem__, a)) != raw or b"".join(map(own.bytes_b.__getitem__, b)) != raw:
        return None
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def diagonals(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ordered lists (of equal values a's first) crosses every ``size``-th diagonal: how many of a and of b lie before it."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, size), total)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        before = a[middle] <= b[at[open_] - 1 - middle]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low, at - low


def piece(a: np.ndarray, b: np.ndarray, first: tuple[int, int], last: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (two arrays of token positions) and closings (positions in b of the tokens at whose end both end) of one piece of the merge."""
    (i0, j0), (i1, j1) = first, last
    own_a, own_b = a[i0:i1], b[j0:j1]
    at_a = j0 + np.searchsorted(own_b, own_a)
    upto = i0 + np.searchsorted(own_a, own_b, side="right")
    # The end of a that equals one of b may be the last before the piece.
    closes = (upto > 0) & (a[np.maximum(upto, 1) - 1] == own_b) if len(a) else np.zeros(len(own_b), dtype=bool)
    alone = np.flatnonzero(~closes)
    links_a = np.concatenate([np.arange(i0, i1), upto[alone]])
    links_b = np.concatenate([at_a, j0 + alone])
    return links_a, links_b, j0 + np.flatnonzero(closes)


def merged(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and closed groups of two lists of ends with the same last value: link positions in a and b, group ends in a and b (exclusive)."""
    at = list(zip(*(x.tolist() for x in diagonals(a, b, size)), strict=True))
    found = [piece(a, b, first, last) for first, last in zip(at, at[1:], strict=False)]
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    links_a, links_b, closes = (np.concatenate(x) for x in zip(*found, strict=True))
    return links_a, links_b, np.searchsorted(a, b[closes], side="right"), closes + 1


class Laid(NamedTuple):
    """What the merge says of documents laid one after the other: per document its counts and spelled groups, and all links as id pairs, in order of documents."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray


def laid(parts: list[tuple[np.ndarray, np.ndarray]], own: Tokenizers) -> Laid:
    """The alignment of several documents with tokens at once."""
    n_a, n_b = (np.array([len(p[k]) for p in parts], dtype=np.int64) for k in (0, 1))
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ends_a, ends_b = np.cumsum(own.sizes_a[a]), np.cumsum(own.sizes_b[b])
    links_a, links_b, groups_a, groups_b = merged(ends_a, ends_b)
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    documents = np.searchsorted(last_a, links_a, side="right")
    order = np.argsort(documents, kind="stable")
    # Tokens in the order in which groups list them: a's of a group, then b's.
    group_of_a = np.searchsorted(groups_a, np.arange(len(a)), side="right")
    group_of_b = np.searchsorted(groups_b, np.arange(len(b)), side="right")
    listed = np.empty(len(a) + len(b), dtype=np.int64)
    before = np.append(0, groups_b)
    close_a, close_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    close_a[groups_a - 1] = 1
    close_b[groups_b - 1] = 1
    close_b[last_b - 1] = 2
    size_a, size_b = len(own.bytes_a), len(own.bytes_b)
    listed[np.arange(len(a)) + before[group_of_a]] = a + size_a * close_a
    listed[np.arange(len(b)) + groups_a[group_of_b]] = 2 * size_a + b + size_b * close_b
    edges = np.append(0, last_a + last_b).tolist()
    spelled = own.spelled.__getitem__
    return Laid(
        n_a, n_b, np.diff(np.searchsorted(groups_a, last_a, side="right"), prepend=0), np.bincount(documents, minlength=len(parts)),
        [b"".join(map(spelled, listed[s:e].tolist())) for s, e in zip(edges, edges[1:], strict=False)],
        ((a[links_a] << SHIFT) | b[links_b])[order])


def blocks(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, spell: bool) -> DataFrame:
    """Written once: per block a row for each different id pair (pair, n at its slot) and one for each document with its counts and packed slots."""
    rows = keyed(docs, key, text)
    kind = rows.schema[0].dataType
    k = to_arrow_type(kind)
    long = pa.int64()
    fields = [("block", long), ("slot", pa.int32()), ("pair", long), ("n", long), ("key", k), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("sha", pa.string()), ("groups", pa.string()), ("slots", pa.binary())]
    schema = pa.schema(fields)

    def listed(block: int, parts: list[tuple[list, Laid]], plain: list) -> Iterator[pa.RecordBatch]:
        """The rows of a block: documents with tokens, as laid, and the keys of those without."""
        size = [np.concatenate([getattr(x, c) for _, x in parts]) if parts else np.zeros(0, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")]
        pairs = np.concatenate([x.pairs for _, x in parts]) if parts else np.zeros(0, dtype=np.int64)
        different, slots, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        lines, edges = len(different), np.append(0, np.cumsum(size[3])).tolist()
        for start in range(0, lines, 1 << 16):
            part = slice(start, start + (1 << 16))
            own = len(different[part])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(own, block)), pa.array(np.arange(start, start + own, dtype=np.int32)), pa.array(different[part]), pa.array(counts[part]), *(pa.nulls(own, t) for _, t in fields[4:])], schema=schema)
        # A document's slots in order, as steps: small numbers that compress well.
        packed = [pa.compress(np.diff(np.sort(slots[s:e]), prepend=0).astype("<u4").tobytes(), codec="zstd", asbytes=True) for s, e in zip(edges, edges[1:], strict=False)]
        keys = [name for names, _ in parts for name in names] + plain
        texts = [g for _, x in parts for g in x.groups]
        sha = [hashlib.sha256(g).hexdigest() for g in texts] + [""] * len(plain)
        groups = [g.decode() for g in texts] + [""] * len(plain) if spell else [None] * len(keys)
        rest = np.zeros(len(plain), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(keys), block)), *(pa.nulls(len(keys), t) for _, t in fields[1:4]), pa.array(keys, k), *(pa.array(np.concatenate([x, rest])) for x in size),
            pa.array(sha, pa.string()), pa.array(groups, pa.string()), pa.array(packed + [b""] * len(plain), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        done: list[tuple[list, Laid]] = []
        names: list = []
        parts: list = []
        plain: list = []
        tokens = links = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encoded(value.as_py(), own)
                if found is None:
                    plain.append(name)
                else:
                    names.append(name)
                    parts.append(found)
                    tokens += len(found[0]) + len(found[1])
                if tokens >= LAID:
                    done.append((names, laid(parts, own)))
                    links += len(done[-1][1].pairs)
                    names, parts, tokens = [], [], 0
                if links >= LINKS or len(plain) >= LAID:
                    yield from listed(block, done, plain)
                    block, done, plain, links = block + 1, [], [], 0
        if parts:
            done.append((names, laid(parts, own)))
        if done or plain:
            yield from listed(block, done, plain)

    types = f"block long, slot int, pair long, n long, key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, sha string, groups string, slots binary"
    return written(rows.mapInArrow(run, types), "zstd")


def counted(lines: DataFrame) -> DataFrame:
    """Per id pair its links in the whole corpus and whether no other pair of its id of B has more, from rows (pair, n)."""
    counts = written(lines.groupBy("pair").agg(F.sum("n").alias("links")))
    of_b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("links").alias("highest"))
    return counts.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", spell: bool = True) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum, the digest of its groups, and with ``spell`` the groups as text."""
    found = blocks(docs, path_a, path_b, key, text, spell)
    lines = found.where("slot IS NOT NULL").select("block", "slot", "pair", "n")
    answers = lines.join(counted(lines), "pair").select("block", "slot", "links", "best")
    kind = found.schema["key"].dataType
    k = to_arrow_type(kind)
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, links, best = None, [], []
        for batch in batches:
            block, is_document = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.int8)
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(is_document) != 0)) + 1).tolist(), len(block)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if block[start] != now:
                    now, links, best = block[start], [], []
                if not is_document[start]:
                    links.append(part.column(2).to_numpy())
                    best.append(part.column(3).to_numpy(zero_copy_only=False))
                    continue
                if len(links) > 1:
                    links, best = [np.concatenate(links)], [np.concatenate(best)]
                n_best, total = [], []
                for size, packed in zip(part.column(8).to_pylist(), part.column(11).to_pylist(), strict=True):
                    if not size:
                        n_best.append(0)
                        total.append(0)
                        continue
                    slots = np.cumsum(np.frombuffer(pa.decompress(packed, decompressed_size=4 * size, codec="zstd"), dtype="<u4"), dtype=np.int64)
                    n_best.append(int(best[0][slots].sum()))
                    total.append(int(links[0][slots].sum()))
                yield pa.RecordBatch.from_arrays([part.column(4), *(part.column(c) for c in (5, 6, 7, 8)), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part.column(9), part.column(10)], names)

    documents = found.where("slots IS NOT NULL").drop("pair", "n", "slot")
    both = answers.unionByName(documents, allowMissingColumns=True)
    both = both.select("block", "slot", "links", "best", "key", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", "slots")
    # The order of slots is their place in the block's list.
    ordered = both.repartition("block").sortWithinPartitions("block", F.col("slot").asc_nulls_last())
    # Column positions in run(): 4 key, 5-8 counts, 9 digest, 10 groups, 11 slots.
    out = ordered.mapInArrow(run, f"key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return (out if spell else out.drop("groups")).withColumnRenamed("key", key)
