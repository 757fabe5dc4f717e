"""Spelling variants: words that differ by one letter, found by partition-and-enumerate signatures, grouped under the commonest form.

1. Words are maximal runs of Latin-1 letters, A-Z lower-cased; tasks count them per document and send one partial sum per word. A run whose
   digest (crc32 of id, colon, run) is divisible by ``ODD`` loses the letter that the digest points at; that is part of the contract.
2. Words of ``LEAST`` letters that occur ``TIMES`` times are the vocabulary, written once. A word's letters are a multiset, hence a binary vector with
   a dimension per letter and repetition. One replaced letter changes at most two dimensions, one more or less changes one.
3. Partition and enumerate: the letters are dealt into ``PARTS`` parts. Vectors at a distance of at most d agree on all parts but d, so the
   hashes of all choices of ``PARTS`` - d parts are exact signatures, for words of the same length (d = 2) and for lengths that differ by one (d = 1),
   each with the length of the shorter word. Words one edit apart also agree on the first half of the shorter one's letters or on its last half, so
   each signature comes once with either half. That loses no pair, and what shares a signature is few words however large the vocabulary is.
4. Equal signatures meet in an equi-join over one shuffle and are verified there as edit distance 1; pairs are then made distinct.
5. A word's form is its near word of largest count if that is at least twice its own; forms are followed by pointer jumping, and as counts double with each
   step, a path of 2^k forms takes k rounds.

Nothing is capped. Results for odd input: a null text has no words, a null id stands as the empty string in the digest; rows that repeat an id are read
each. Very long texts and runs are read whole. Ties of forms go to the smallest word in code-point order. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.llm.common import keyed, written
from tablero.llm.jaccard_join import mixed

ODD, LEAST, TIMES, FACTOR = 97, 5, 3, 2
#: Parts of the letters; different words that a task keeps before it sends them; words that are signed at once.
PARTS, FLUSH, SIGNED = 3, 200_000, 4096
#: Roles of a signature: of words of the same length, of the shorter and of the longer one of lengths that differ.
SAME, SHORTER, LONGER = range(3)
#: Per byte of Latin-1: the letter, A-Z lower-cased, or a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_draw = np.random.default_rng(61)
#: Of a letter; of a choice of parts (same length first, then lengths that differ); factors of lengths and places.
LETTER, CHOICE = _draw.integers(0, 2**63, 256, dtype=np.uint64), _draw.integers(0, 2**63, 64, dtype=np.uint64)
LENGTH, PLACE = _draw.integers(0, 2**63, 2, dtype=np.uint64) | np.uint64(1)


def runs(text: str) -> list[bytes]:
    """The runs of a text in Latin-1, which has a byte per code point; any character beyond it ends a run."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def spelled(run: bytes, prefix: int) -> bytes:
    """The run as it counts; ``prefix`` is the crc32 of the id and a colon."""
    digest = crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if digest % ODD:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``LEAST`` letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in count], pa.string()), pa.array(count.values(), pa.int64())], ["word", "n"])
            count.clear()
            return batch

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = crc32(f"{name}:".encode())
                for own, n in Counter(runs(value.as_py())).items():
                    if len(own) >= LEAST:
                        own = spelled(own, prefix)
                        if len(own) >= LEAST:
                            count[own] += n
                if len(count) >= FLUSH:
                    yield flushed()
        if count:
            yield flushed()

    named = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key), text)
    return keyed(named, key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def signatures(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Role and one key per word, for every choice of parts and either half."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    letters = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    behind = np.repeat(sizes, sizes) - 1 - place

    def summed(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(where, values, np.uint64(0)), starts)

    part = letters % PARTS
    parts = np.stack([summed(LETTER[letters], part == p) for p in range(PARTS)])
    ahead, back = (mixed(LETTER[letters] + at.astype(np.uint64) * PLACE) for at in (place, behind))
    choices = [(d, [p for p in range(PARTS) if p not in gone]) for d in (2, 1) for gone in combinations(range(PARTS), d)]
    for role in (SAME, SHORTER, LONGER):
        # All of it follows the length of the shorter word of a pair.
        size = sizes - (role == LONGER)
        half = size // 2
        halves = [mixed(summed(ahead, place < np.repeat(half, sizes)) + size.astype(np.uint64) * LENGTH), mixed(summed(back, behind < np.repeat(size - half, sizes)) - size.astype(np.uint64) * LENGTH)]
        for i, (d, kept) in enumerate(choices):
            if (d == 2) == (role == SAME):
                own = mixed(parts[kept].sum(axis=0, dtype=np.uint64) + CHOICE[i])
                yield from ((role, mixed(own ^ h)) for h in halves)


def signed(vocabulary: DataFrame) -> DataFrame:
    """(key, role, word): per word a row for each of its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SIGNED):
                column = batch.column(0).slice(start, SIGNED)
                for role, keys in signatures([w.encode("latin-1") for w in column.to_pylist()]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), role, dtype=np.int32)), column], ["key", "role", "word"])

    return vocabulary.select("word").mapInArrow(run, "key long, role int, word string")


def pairs(vocabulary: DataFrame) -> DataFrame:
    """(one, two): every unordered pair of words one edit apart, once."""
    # A join by merging: the size that Spark assumes for these rows is the vocabulary's, which is far smaller.
    rows = signed(vocabulary).hint("merge")
    # Both roles stand in one expression, so neither side is filtered before the shuffle, which then serves both.
    roles = F.col("l.role") * 3 + F.col("r.role")
    met = rows.alias("l").join(rows.alias("r"), (F.col("l.key") == F.col("r.key")) & ((roles == 3 * SHORTER + LONGER) | ((roles == 0) & (F.col("l.word") < F.col("r.word")))) & F.expr("levenshtein(l.word, r.word, 1) = 1"))
    return met.select(F.col("l.word").alias("one"), F.col("r.word").alias("two")).distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer jumping; the last of a path has no form."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word of the vocabulary: n, form, root, n_near and form_n."""
    vocabulary = written(words(docs, key, text).where(F.col("n") >= TIMES))
    near = written(pairs(vocabulary))
    both = near.unionByName(near.select(F.col("two").alias("one"), F.col("one").alias("two")))
    counted = both.join(vocabulary.select(F.col("word").alias("two"), F.col("n").alias("two_n")), "two")
    # The least of (-count, word) is the largest count, ties to the smallest word.
    best = counted.groupBy(F.col("one").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("two_n")).alias("less"), F.col("two").alias("form"))).alias("best"))
    known = vocabulary.join(best, "word", "left")
    large = -F.col("best.less") >= FACTOR * F.col("n")
    formed = written(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")))
    roots = rooted(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
