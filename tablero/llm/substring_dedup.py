"""Removal of word passages that occur more than once, decided by a compressed full-text index per shard.

A window is ``WINDOW`` consecutive words of one text. Every word that lies in a window occurring anywhere else goes.

1. Each window elects its anchor, the smallest hash among its runs of ``GRAM`` words, so equal windows have equal anchors and consecutive windows
   mostly share one. Anchors that occur once in the corpus cannot belong to a repeated window and are left behind.
2. The windows that one anchor owns are contiguous; their words are its segment. Each window of the corpus lies in exactly one
   segment, and all windows equal to it lie in segments of the same anchor.
3. Segments are dealt by anchor. A task gathers whole anchors into shards of about ``SHARD`` words, indexes the shard's different segments, each with the
   number of its occurrences as weight, and streams them through the index: backward search gives, for each position, how many words up to
   it occur at least twice. Where that reaches the window length, the window is reported.
4. Reports return to the texts, which lose the union of their reported windows.

Texts that equal each other whole are cut into segments once; their segments carry the number of copies into the index. An anchor that occurs in
more than ``HOT`` places of different texts (a passage or line in very many texts) is divided by content: its windows go one by one, keyed by
anchor and their four first and four last words, equal ones pre-aggregated to one row with a count. So no shard depends on how common a passage is, and
joins on anchors and segments keep the rows of very common ones where they are.

Words count as equal if their 64-bit hashes are. Nothing is capped: every text is read whole, every repeated anchor is followed.

Results for odd input: a null or empty text has no words; texts shorter than a window keep all words. Repeated rows are copies of each
other, so their windows are repeated. A null id is an id like any other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.llm.common import heavy_join, words_of, written
from tablero.llm.fm_index import Index
from tablero.llm.jaccard_join import mixed

WINDOW, GRAM = 35, 8
#: Bytes of texts whose words are hashed in one go, and of a word beyond which it is hashed by itself.
STRETCH, LONG = 1 << 21, 512
#: Occurrences of an anchor beyond which its windows are dealt by content, words of a shard, words at either end that make the finer key.
HOT, SHARD, EDGE = 2048, 200_000, 4
#: Bits for the number of windows that one anchor owns, at most WINDOW - GRAM + 1.
OWNED = 5
_draw = np.random.default_rng(41)
GRAM_FACTORS = (_draw.integers(0, 2**63, GRAM, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
EDGE_FACTORS = (_draw.integers(0, 2**63, 2 * EDGE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SIZE_FACTOR, STEP_FACTOR = (_draw.integers(0, 2**63, 2, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The bytes of a word that are left, up to eight, as a mask on its next eight bytes.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class Words:
    """The words of some texts in UTF-8, one text after the other: where they start in ``data``, their sizes in bytes, and how many each text has."""

    def __init__(self, texts: list[bytes]):
        # Gaps part the texts; those at the end can be read beyond the last word.
        self.data = np.frombuffer(b" %b%b" % (b" ".join(texts), b" " * 8), dtype=np.uint8)
        self.gap = GAPS[self.data]
        edges = np.flatnonzero(self.gap[1:] != self.gap[:-1]) + 1
        self.starts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        self.ends = np.searchsorted(self.starts, ends)
        self.counts = np.diff(self.ends, prepend=0)

    def hashes(self) -> np.ndarray:
        """64 bits per word, from its size and its bytes, eight at a time."""
        eight = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.data, strides=(1,))
        out = mixed((eight[self.starts] & MASKS[np.minimum(self.sizes, 8)]) ^ self.sizes.astype(np.uint64) * SIZE_FACTOR)
        rest, at = np.flatnonzero((self.sizes > 8) & (self.sizes <= LONG)), 8
        while len(rest):
            left = self.sizes[rest] - at
            out[rest] = mixed(out[rest] * STEP_FACTOR ^ (eight[self.starts[rest] + at] & MASKS[np.minimum(left, 8)]))
            rest, at = rest[left > 8], at + 8
        for i in np.flatnonzero(self.sizes > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes())
        return out

    def digests(self) -> list[str]:
        """For each text the digest of its words joined by one space."""
        # Each word with the gap behind it.
        kept = np.append(False, ~self.gap[:-1] | ~self.gap[1:])
        kept[1:] &= ~(self.gap[1:] & self.gap[:-1])
        joined = memoryview(np.where(self.gap, np.uint8(0x20), self.data)[kept].tobytes())
        ends = np.append(0, np.cumsum(self.sizes + 1))[np.append(0, self.ends)].tolist()
        return [hashlib.sha256(joined[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]


def stretches(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The texts of a column in stretches of about ``STRETCH`` bytes: the row where each starts, and its words."""
    before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // STRETCH
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, Words(texts.slice(a, b - a).cast(pa.binary()).to_pylist())


def elected(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the windows of texts, given their hashed words and how many each has: text, first window that the anchor owns, how many, hash."""
    if len(words) < WINDOW:
        return *(np.empty(0, dtype=np.int64) for _ in range(3)), np.empty(0, dtype=np.uint64)
    count = len(words) - GRAM + 1
    grams = np.zeros(count, dtype=np.uint64)
    spread = mixed(words)
    for j in range(GRAM):
        grams += spread[j : j + count] * GRAM_FACTORS[j]
    grams = mixed(grams)
    # The smallest of ever longer runs of grams, of equal ones the first; along a text its position never falls.
    least, at, reach, span = grams, np.arange(count), 1, WINDOW - GRAM + 1
    while reach < span:
        step = min(reach, span - reach)
        later = least[step:] < least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        reach += step
    # Only windows inside one text.
    windows = np.maximum(counts - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = at[(np.cumsum(counts) - counts)[owner] + nth]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return owner[first], nth[first], np.diff(first, append=len(at)), grams[at[first]]


def identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, text (null: empty) and the digest of the text in two columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), whole.alias("text"), F.xxhash64(F.lit(1), whole).alias("t1"), F.xxhash64(F.lit(2), whole).alias("t2"))


def kept_digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def anchored(rows: DataFrame) -> DataFrame:
    """Written once, per row: number, key, text digest, n_words, digest of all words, and its anchors (the first window that each owns and how many, in one
    number, and the anchor's hash)."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in stretches(batch.column(1)):
                owner, first, windows, anchors = elected(words.hashes(), words.counts)
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(words.counts)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (first << OWNED | windows, anchors.view(np.int64))]
                own = batch.slice(start, len(words.counts))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), own.column(3), pa.array(words.counts, pa.int64()), pa.array(words.digests(), pa.string()), *lists],
                    ["key", "t1", "t2", "n_words", "digest", "places", "hashes"])

    found = rows.mapInArrow(run, f"key {kind}, t1 long, t2 long, n_words long, digest string, places array<long>, hashes array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()))


def flushed(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    for c in columns:
        c.clear()
    return batch


class Segments:
    """Texts and their segments, gathered for one batch of output."""

    def __init__(self) -> None:
        self.texts: list[list] = [[], [], [], []]
        self.counts, self.starts, self.keys, self.hots, self.words = [0], [], [], [], []
        self.size = 0

    def add(self, row: list, words: np.ndarray, places: np.ndarray, anchors: np.ndarray, hot: np.ndarray) -> None:
        raw, first, windows = words.tobytes(), places >> OWNED, places & ((1 << OWNED) - 1)
        cold = ~hot
        starts, sizes = first[cold], windows[cold] + WINDOW - 1
        own = [raw[8 * s : 8 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        # Of hot anchors each window by itself, its key made of the anchor and the words at both ends.
        many = windows[hot]
        each = np.repeat(first[hot] - np.cumsum(many) + many, many) + np.arange(many.sum())
        edges = np.zeros(len(each), dtype=np.uint64)
        for j in range(EDGE):
            edges += mixed(words[each + j] + EDGE_FACTORS[j]) * EDGE_FACTORS[j]
            edges += mixed(words[each + WINDOW - EDGE + j] + EDGE_FACTORS[EDGE + j]) * EDGE_FACTORS[EDGE + j]
        finer = mixed(edges ^ np.repeat(anchors[hot], many).view(np.uint64)).view(np.int64)
        own += [raw[8 * s : 8 * (s + WINDOW)] for s in each.tolist()]
        for c, x in zip(self.texts, row, strict=True):
            c.append(x)
        self.counts.append(len(own))
        self.starts.append(np.concatenate([starts, each]))
        self.keys.append(np.concatenate([anchors[cold], finer]))
        self.hots.append(np.arange(len(own)) >= len(starts))
        self.words += own
        self.size += sum(map(len, own))

    def batch(self) -> pa.RecordBatch:
        fields = [np.concatenate(self.starts).astype(np.int32), np.concatenate(self.keys), np.concatenate(self.hots), pa.array(self.words, pa.binary())]
        segments = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["start", "key", "hot", "words"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(self.counts).astype(np.int32)), segments)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(self.texts, kinds, strict=True)), lists], ["t1", "t2", "text", "copies", "segments"])


def segmented(texts: DataFrame) -> DataFrame:
    """From (t1, t2, text, copies, places: array of (place, hash, hot)) the written table (t1, t2, text, copies, segments)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Segments()
        for batch in batches:
            for start, stretch in stretches(batch.column(2)):
                for i, words in enumerate(np.split(stretch.hashes(), stretch.ends[:-1]), start):
                    row = [batch.column(c)[i].as_py() for c in range(4)]
                    places = batch.column(4)[i].values
                    place, anchors, hot = (places.field(c).to_numpy(zero_copy_only=False) for c in ("place", "hash", "hot"))
                    out.add(row, words, place, anchors, hot)
                    if out.size > 4 << 20:
                        yield out.batch()
                        out = Segments()
        if len(out.counts) > 1:
            yield out.batch()

    return written(texts.mapInArrow(run, "t1 long, t2 long, text string, copies long, segments array<struct<start: int, key: long, hot: boolean, words: binary>>"))


def search(shard: dict[bytes, list[int]]) -> Iterator[tuple[bytes, bytes, int]]:
    """The segments of a shard that hold repeated windows, with one byte (0 or 1) per window and the number of texts' places they stand in. The shard
    has for each segment how often it occurs, copies of texts included, and in how many places of different texts."""
    segments = list(shard)
    sizes = np.array([len(x) // 8 for x in segments], dtype=np.int64)
    words = np.frombuffer(b"".join(segments), dtype=np.uint64)
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Each segment and a separator.
    spread = np.zeros(len(symbols) + len(segments), dtype=np.int64)
    spread[np.arange(len(symbols)) + np.repeat(np.arange(len(segments)), sizes)] = symbols
    index = Index(spread, np.repeat(np.array([shard[x][0] for x in segments], dtype=np.int64), sizes + 1))
    windows = sizes - WINDOW + 1
    # First whole segments (they are shorter than what the index orders): if one occurs twice, so do all its windows.
    whole = index.matches(symbols, ends - 1, sizes) == sizes
    owner = np.repeat(np.arange(len(segments)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = whole[owner]
    rest = np.flatnonzero(~found)
    found[rest] = index.matches(symbols, starts[owner[rest]] + nth[rest] + WINDOW - 1, WINDOW) >= WINDOW
    marks = found.astype(np.uint8).tobytes()
    at = 0
    for i, count in enumerate(windows.tolist()):
        own = marks[at : at + count]
        at += count
        if b"\x01" in own:
            yield segments[i], own, shard[segments[i]][1]


def repeated(segments: DataFrame) -> DataFrame:
    """(w1, w2, marks, places) of the different segments that hold repeated windows, from (key, words, n, places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[bytes, list[int]] = {}
        size, now = 0, None
        names, kinds = ["words", "marks", "places"], [pa.binary(), pa.binary(), pa.int64()]

        def report() -> Iterator[pa.RecordBatch]:
            out: list[list] = [[], [], []]
            for found in search(shard):
                for c, x in zip(out, found, strict=True):
                    c.append(x)
            if out[0]:
                yield flushed(out, kinds, names)

        for batch in batches:
            for key, words, n, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now and size >= SHARD:
                    yield from report()
                    shard, size = {}, 0
                now = key
                if words not in shard:
                    size += len(words) // 8
                own = shard.setdefault(words, [0, 0])
                own[0] += n
                own[1] += places
        if shard:
            yield from report()

    found = segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, "words binary, marks binary, places long")
    return found.select(*digest("words"), "marks", "places")


def digest(words: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), words).alias("w1"), F.xxhash64(F.lit(2), words).alias("w2")


def cleaned(texts: DataFrame) -> DataFrame:
    """From (t1, t2, text, marks: array of (start, marks)) the kept words: n_removed, digest and kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for value, marks in zip(batch.column(2), batch.column(3), strict=True):
                words = words_of(value.as_py())
                starts, bits = marks.values.field("start").to_numpy(), marks.values.field("marks").to_pylist()
                counts = np.array([len(x) for x in bits])
                ahead = np.cumsum(counts) - counts
                at = np.flatnonzero(np.frombuffer(b"".join(bits), dtype=np.uint8))
                segment = np.searchsorted(ahead, at, side="right") - 1
                at = starts[segment] + at - ahead[segment]
                # Each window start opens, its end closes.
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
                own = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                removed.append(len(words) - len(own))
                digests.append(kept_digest(own))
                kept.append(" ".join(own))
            arrays = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["t1", "t2", "n_removed", "digest", "kept"])

    return texts.mapInArrow(run, "t1 long, t2 long, n_removed long, digest string, kept string")


def stages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (anchored) and the changed texts (t1, t2, n_removed, digest, kept)."""
    whole = identity(docs, key, text)
    rows = anchored(whole)
    texts = written(rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("row").alias("row"))).select("row", "copies")
    anchors = rows.select("row", F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("hashes").alias("hash"))).alias("a")).select("row", "a.place", "a.hash")
    total = rows.agg(F.sum(F.size("places"))).first()[0] or 0
    twice = written(anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    # One row per different text from here on.
    candidates = written(heavy_join(anchors, twice, ["hash"], "n", total).drop("n").join(texts, "row"))
    counts = written(candidates.groupBy("hash").agg(F.count("*").alias("n")).withColumn("hot", F.col("n") > HOT))
    placed = heavy_join(candidates, counts, ["hash"], "n", candidates.count())
    places = placed.groupBy("row", "copies").agg(F.sort_array(F.collect_list(F.struct("place", "hash", "hot"))).alias("places"))
    owners = rows.select("row", F.col("key").alias("own"), "t1", "t2").join(places, "row").drop("row")
    same = F.col("key").eqNullSafe(F.col("own")) & (whole.t1 == owners.t1) & (whole.t2 == owners.t2)
    found = segmented(whole.join(owners, same).select(whole.t1, whole.t2, "text", "copies", "places"))
    flat = found.select("t1", "t2", "copies", F.explode("segments").alias("s")).select("t1", "t2", "copies", "s.start", "s.key", "s.hot", "s.words")
    single = flat.where("NOT hot").select("key", "words", F.col("copies").alias("n"), F.lit(1).cast("long").alias("places"))
    common = flat.where("hot").groupBy("key", "words").agg(F.sum("copies").alias("n"), F.count("*").alias("places"))
    marks = written(repeated(single.unionByName(common)))
    named = flat.select("t1", "t2", "start", *digest("words"))
    pieces = found.agg(F.sum(F.size("segments.start"))).first()[0] or 0
    reports = heavy_join(named, marks, ["w1", "w2"], "places", pieces).groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "marks")).alias("marks"))
    # A repeated id with one text stands here more than once.
    return rows, cleaned(found.select("t1", "t2", "text").join(reports, ["t1", "t2"]).dropDuplicates(["t1", "t2"]))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row n_words, n_removed and the digest of the kept words."""
    rows, changed = stages(docs, key, text)
    narrow = rows.select("key", "t1", "t2", "n_words", "digest").join(changed.select("t1", "t2", "n_removed", F.col("digest").alias("new")), ["t1", "t2"], "left")
    return narrow.select(F.col("key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("new", "digest").alias("kept_sha256"))


def cleaned_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the repeated passages taken out of their texts; unchanged texts stay as they are, n_chars follows."""
    _, changed = stages(docs, key, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumns({"_t1": F.xxhash64(F.lit(1), whole), "_t2": F.xxhash64(F.lit(2), whole)})
    by_text = changed.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("kept").alias("_kept"))
    out = marked.join(by_text, ["_t1", "_t2"], "left").withColumn(text, F.coalesce("_kept", text)).select(*docs.columns)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out
