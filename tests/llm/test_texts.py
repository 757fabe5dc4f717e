"""Byte-level BPE, packing, training order, quality rules, toxicity and HTML extraction against plain re-computation."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablero.llm import bpe, html_text, packing, quality_rules, registry, toxicity, training_order
from tablero.llm.boosting import boost
from tablero.llm.common import shared_dir
from tablero.llm.word_bpe import Words
from tests.llm.frames import SMALL, documents, odd_texts, prose, quality_counts

RANKS, VOCABULARY = public_tokenizers.path(bpe.RANKS), public_tokenizers.path("word_bpe_49k.json")


def test_bpe_round_trip(spark):
    rows = odd_texts()
    found = bpe.round_trip(documents(spark, rows), RANKS).collect()
    whole = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    want = []
    for key, text in rows:
        ids = whole.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, found)) == Counter(want)
    assert bpe.round_trip(documents(spark, []), RANKS).count() == 0


def test_bpe_cuts_long_texts_safely():
    draw = random.Random(3)
    text = "".join(draw.choice(["a", "B", " ", "  ", "\n", "'s", "7", ".", "é", "…", " x"]) for _ in range(20_000))
    whole = bpe.encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary(text)
    for size in (1, 17, 500):
        pieces = list(bpe.parts(text, size))
        assert "".join(pieces) == text
        ids = [i for piece in pieces for i in bpe.encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary(piece)]
        assert ids == whole
    assert list(bpe.parts("x" * 1000, 10)) == ["x" * 1000]
    ids = bpe.encode(text, RANKS)
    assert bpe.decode(ids, RANKS) == text.encode()


def test_word_ids_are_those_of_the_tokenizer():
    memo, draw = Words(VOCABULARY), random.Random(1)
    assert memo.known
    texts = [t or "" for _, t in odd_texts()] + ["İstanbul ΣΑΣ ς é é \x00a \x1cb <|endoftext|> <|EndOfText|> can't CAN'T '’s", "a̸ ≠ ½ ² ٣ 漢字か゛"]
    alphabets = ["aeinst'lrdTHE .,0123é-", "".join(map(chr, range(1, 256))), "aé–漢́​ Ω ß'sİ"]
    texts += ["".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        assert memo.ids(text) == np.array(memo.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def reference_pieces(rows, capacity):
    tokenizer, out = Words(VOCABULARY).whole, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], dtype="<u4")
            out.append((key, piece, start, len(own), zlib.crc32(own.tobytes())))
    return out


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, capacity):
    rows = [*odd_texts(), *((100 + i, prose(i, i % 90)) for i in range(300))]
    found = packing.pack(documents(spark, rows).repartition(5), VOCABULARY, capacity).collect()
    want = reference_pieces(rows, capacity)
    assert Counter(tuple(r)[:5] for r in found) == Counter(want)
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    # Best-fit decreasing, one piece at a time, needs as many sequences.
    free: list[int] = []
    for length in sorted((w[3] for w in want), reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else capacity) - length)
    assert len(places) == len(free)
    assert packing.pack(documents(spark, []), VOCABULARY).count() == 0


def test_plan_size_does_not_follow_the_counts():
    draw = random.Random(2)
    counts = {n: draw.randint(1, 50) for n in range(1, 2049)}
    small, large = packing.plan(counts), packing.plan({k: v * 1_000_003 for k, v in counts.items()})
    assert len(large) < 3 * 2048 * 11 and len(small) < 3 * 2048 * 11


@pytest.mark.parametrize("count", [1, 2, 3, 17, 256, 1000, 4097])
def test_permutation_is_a_bijection(count):
    out = training_order.permuted(np.arange(count), count, 99)
    assert sorted(out.tolist()) == list(range(count))
    assert count < 17 or out.tolist() != training_order.permuted(np.arange(count), count, 100).tolist()


def test_training_order(spark, tmp_path):
    rows = [*odd_texts(), *((100 + i, prose(i, 40 + i)) for i in range(60))]
    folder, stride, size = f"file://{tmp_path}/shards", 32, 10
    docs = documents(spark, rows).repartition(4)
    found = training_order.shards(docs, VOCABULARY, 11, folder, stride, size).collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(reference_pieces(rows, stride))
    assert sorted(r.slot for r in found) == list(range(len(found)))
    records = training_order.read_from(folder, 0, len(found), stride, size)
    for r in found:
        assert (r.shard, r.record) == divmod(r.slot, size)
        assert zlib.crc32(records[r.slot].tobytes()) == r.record_crc32
        assert zlib.crc32(records[r.slot][: r.length].tobytes()) == r.ids_crc32
        assert (records[r.slot][r.length :] == training_order.PAD).all()
    # A reader that resumes gets what a reader from the start gets; a second run leaves the same files.
    assert (training_order.read_from(folder, 13, 21, stride, size) == records[13:34]).all()
    before = {p.name: p.read_bytes() for p in (tmp_path / "shards").iterdir()}
    again = training_order.shards(docs, VOCABULARY, 11, folder, stride, size).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert {p.name: p.read_bytes() for p in (tmp_path / "shards").iterdir()} == before
    assert training_order.shards(documents(spark, []), VOCABULARY, 11).count() == 0


def test_sequences_travel_packed(spark):
    """What is moved between tasks is much smaller than the sequences, and nothing of them is lost, whatever the key."""
    rows = [*((str(i), prose(i, 200)) for i in range(300)), ("0", prose(0, 200)), (None, "x"), (None, None), ("a", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)
    sequences, count = training_order.slots(docs, VOCABULARY, 5, 64)
    ordered = training_order.by_range(sequences, count, 8, 7)
    # The exchange holds no single sequences.
    exchange = next(line for line in ordered._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    assert "partition" in exchange and "slot" not in exchange
    packages = training_order.packed(sequences, count, 8, 7)
    numbers = [r.partition for r in packages.select("partition").collect()]
    assert set(numbers) == set(range(7)) and len(numbers) <= 7 * 2
    moved = packages.agg(F.sum(F.length("content"))).first()[0]
    assert moved < 0.9 * sequences.agg(F.sum(F.length("ids"))).first()[0]
    assert Counter(map(tuple, ordered.select(*sequences.columns).collect())) == Counter(map(tuple, sequences.collect()))
    at = ordered.select("slot", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.slot // 8 * 7 // -(-count // 8) for r in at) and [r.slot for r in at] == list(range(count))
    assert training_order.by_range(sequences.limit(0), 0, 8, 7).count() == 0


def test_training_order_query_writes_its_shards(spark):
    """The registered query leaves the shard files, their digests are in its rows, and they hold the ids of every sequence."""
    found = registry.op9_training_order(spark, SMALL).collect()
    folders = list(Path(shared_dir(spark).removeprefix("file:").replace("//", "/")).glob("shards-*"))
    files = {int(p.stem[6:]): p.read_bytes() for p in max(folders, key=lambda p: p.stat().st_mtime).glob("*.bin")}
    assert {r.shard: r.shard_crc32 for r in found} == {k: zlib.crc32(raw) for k, raw in files.items()}
    for r in found:
        own = np.frombuffer(files[r.shard], dtype="<u2").reshape(-1, training_order.STRIDE)[r.record].astype("<u4")
        assert zlib.crc32(own.tobytes()) == r.record_crc32
        assert zlib.crc32(own[: r.length].tobytes()) == r.ids_crc32


def test_wide_ids_are_not_cut():
    assert packing.narrowed(np.array([1, 65535], dtype="<u4").tobytes(), 2) == np.array([1, 65535], dtype="<u2").tobytes()
    with pytest.raises(ValueError):
        packing.narrowed(np.array([65536], dtype="<u4").tobytes(), 2)


def test_quality_counts(spark):
    rows = [*odd_texts(), (50, "a b c a b c\nx\nx\n \n#$ <&>"), (51, "w " * 70), (52, prose(9, 60), None, None)]
    found = quality_rules.judged(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    want = Counter()
    for key, text, *_ in rows:
        n, chars, symbols, lines, repeats = quality_counts(text)
        want[key, n, chars, symbols, lines, repeats, n < 50 or 100 * repeats > 50 * n] += 1
    assert Counter(tuple(r)[:7] for r in found) == want
    assert not any(r.kept for r in found if r.base_failed)
    assert quality_rules.judged(documents(spark, [])).count() == 0


def test_quality_outliers_follow_the_estimates(spark):
    """Junk is rejected in each group, and the distances are those of a plain re-computation of the same steps."""
    rows = []
    for i in range(400):
        text = prose(i, 60 + i % 50)
        if i % 8 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en" if i % 2 else "de", "hot" if i % 3 else f"s{i % 5}"))
    found = {r.doc_id: r for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert {k for k, r in found.items() if not r.kept} == {i for i in range(400) if i % 8 == 0}
    own = [r for r in rows if (r[2], r[3]) == ("en", "hot")]
    counts = np.array([quality_counts(r[1]) for r in own], dtype=float)
    x = np.stack([np.log(counts[:, 1] / counts[:, 0]), *(np.log1p(c) for c in (counts[:, 2] / counts[:, 0], counts[:, 3], counts[:, 4] / counts[:, 0]))], axis=1)
    floor = np.diag(np.square(quality_rules.FLOORS))

    def low(values, share):
        return np.sort(values)[max(1, int(np.ceil(share * len(values)))) - 1]

    def step(centre, cov):
        d = ((x - centre) @ np.linalg.inv(cov) * (x - centre)).sum(1)
        half = x[d <= low(d, 0.5)]
        return half.mean(0), np.cov(half.T, bias=True) * quality_rules.CONSISTENCY + floor

    middle = np.array([low(x[:, j], 0.5) for j in range(4)])
    width = np.sqrt([((low(x[:, j], 0.75) - low(x[:, j], 0.25)) / 1.349) ** 2 + floor[j, j] for j in range(4)])
    bent = np.cov(np.tanh((x - middle) / width).T, bias=True)
    scale = np.sqrt(np.diag(bent))
    shape = np.divide(bent, np.outer(scale, scale), out=np.zeros((4, 4)), where=np.outer(scale, scale) > 0)
    np.fill_diagonal(shape, 1)
    ends = []
    for centre, cov in [(middle, np.diag(width**2)), (x.mean(0), np.cov(x.T, bias=True) + floor), (middle, shape * np.outer(width, width))]:
        for _ in range(quality_rules.TRIAL):
            centre, cov = step(centre, cov)
        ends.append((round(np.linalg.slogdet(cov)[1], 9), len(ends), centre, cov))
    _, _, centre, cov = min(ends, key=lambda e: e[:2])
    falls = []
    while not falls or falls[-1] > 1e-6:
        before, (centre, cov) = cov, step(centre, cov)
        falls.append(np.linalg.slogdet(before)[1] - np.linalg.slogdet(cov)[1])
    assert min(falls) > -1e-9
    d = ((x - centre) @ np.linalg.inv(cov) * (x - centre)).sum(1)
    assert np.allclose([found[r[0]].d2 for r in own], d, rtol=1e-6, atol=1e-9)


def test_each_dimension_rejects_alone(spark):
    """In a clean source one extreme text per dimension goes, and the estimates at the end are those that one more step gives."""
    rows = [(i, prose(i, 60 + i % 50)) for i in range(300)]
    draw, few, line, seen = random.Random(4), prose(900, 20).split(), [], set()
    while len(line) < 100:
        line.append(draw.choice(few))
        if tuple(line[-3:]) in seen:
            line.pop()
        elif len(line) > 2:
            seen.add(tuple(line[-3:]))
    own, other = prose(901, 24), prose(902, 52)
    junk = {
        1000: " ".join(w * 5 for w in prose(903, 80).split()), 1001: " ".join(w[:-1] + "%" * (i % 4 == 0) for i, w in enumerate(prose(904, 80).split())),
        1002: "\n".join(line), 1003: f"{own} {other} {own}"}
    assert quality_counts(junk[1002])[3] >= 70 and quality_counts(junk[1002])[4] == 0 and quality_counts(junk[1003])[3:] == (0, 48)
    rows += junk.items()
    found = {r.doc_id: r for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {k for k, r in found.items() if not r.kept} == set(junk)
    counts = np.array([quality_counts(text) for _, text in rows], dtype=float)
    lines = np.array([text.count("\n") + 1 for _, text in rows])
    x = np.stack([np.log(counts[:, 1] / counts[:, 0]), *(np.log1p(c) for c in (counts[:, 2] / counts[:, 0], counts[:, 3] / lines, counts[:, 4] / counts[:, 0]))], axis=1)
    d = np.array([found[k].d2 for k, _ in rows])
    half = x[d <= np.sort(d)[len(d) // 2 - 1]]
    cov = np.cov(half.T, bias=True) * quality_rules.CONSISTENCY + np.diag(np.square(quality_rules.FLOORS))
    assert np.allclose(((x - half.mean(0)) @ np.linalg.inv(cov) * (x - half.mean(0))).sum(1), d, rtol=1e-6, atol=1e-9)


def test_the_smallest_determinant_of_several_starts(spark):
    """A cloud and a tight second one with 45 % of the rows: groups end with the smallest determinant of the starts, and no step raises it."""
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(0, 1, (330, 4)) @ np.diag([1, 0.8, 0.5, 0.4]) + 2, draw.normal(0, 0.05, (270, 4)) + [5, 3, 4, 2.5]])
    rows = spark.createDataFrame([(i, "en", "s", *map(float, v)) for i, v in enumerate(x)], "key long, lang string, source string, x0 double, x1 double, x2 double, x3 double")
    found = quality_rules.estimates(rows)
    end = found.first().logdet
    assert quality_rules.concentrated(rows, found).first().logdet >= end - 1e-6
    trial = quality_rules.starts(rows)
    assert sorted(r.start for r in trial.select("start").collect()) == [0, 1, 2]
    ways = []
    for _ in range(8):
        trial = quality_rules.written(quality_rules.concentrated(rows, trial))
        ways.append([r.logdet for r in trial.orderBy("start").collect()])
    assert all(b <= a + 1e-9 for way in zip(*ways) for a, b in zip(way, way[1:]))
    best = min(range(3), key=lambda i: (round(ways[quality_rules.TRIAL - 1][i], 9), i))
    assert end <= ways[-1][best] + 1e-9 and end <= min(ways[quality_rules.TRIAL - 1]) + 1e-9
    assert quality_rules.estimates(rows.limit(0)).count() == 0


def toxic_rows(count: int):
    """Documents of ten sentences, one in six with one sentence that holds a bad word."""
    rows, labels = [], []
    for i in range(count):
        sentences = [prose(i * 11 + j, 9) for j in range(10)]
        bad = i % 6 == 0
        if bad:
            sentences[i % 10] += f" {['grunkle', 'snorfel', 'blechity'][i % 3]} you"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_rows(900)
    docs = documents(spark, [*rows, (None, "you grunkle"), (5000, None), (5001, ""), (5002, "..."), (0, rows[0][1])])
    known = spark.createDataFrame([*labels, (None, 1, 1), (7000, 1, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.scored(docs, toxicity.train(docs, known)).collect()
    assert len(found) == 905
    texts, truth = dict(rows), {i: t for i, _, t in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert all(r.predicted == truth[r.doc_id] for r in held)
    for r in held:
        spans = [texts[r.doc_id][s.start : s.end] for s in r.offending]
        assert all(any(w in x for w in ("grunkle", "snorfel", "blechity")) for x in spans) and bool(spans) == bool(truth[r.doc_id])
    assert all(r.score == 0 for r in found if r.doc_id in (5000, 5001, 5002))
    assert all(0 <= r.score <= 1 for r in found)
    model = toxicity.train(docs, known)
    scores = {r[0]: r[1] for r in docs.where("doc_id is not null").select("doc_id", toxicity.score_of(model)("text")).collect()}
    assert all(abs(scores[r.doc_id] - r.score) < 1e-12 for r in found if r.doc_id is not None)


def test_toxicity_without_labels(spark):
    docs = documents(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.scored(docs, toxicity.train(docs, none)).collect()
    assert len(found) == len(odd_texts()) and all(r.predicted == 0 for r in found)
    assert toxicity.scored(documents(spark, []), toxicity.train(documents(spark, []), none)).count() == 0


def test_toxicity_scores_are_noisy_or(spark):
    """Scores against the formula, sentence by sentence, from the words that a model of known weights holds."""
    word = {w: toxicity.features(w)[0] for w in ("vile", "nasty", "kind")}
    model = toxicity.Model({word["vile"]: 6.0, word["nasty"]: 3.5, word["kind"]: -2.0}, -5.0)
    weight = {"vile": 6.0, "nasty": 3.5, "kind": -2.0}
    rows = [(1, "A vile day. Then a nasty, kind one! Plain."), (2, "Nasty nasty. Nasty?"), (3, "Plain. " * 5000), (4, "... !"), (5, "Vile nasty kind\nkind")]
    found = {r.doc_id: r for r in toxicity.scored(documents(spark, rows), model).collect()}
    for number, text in rows:
        none, plain = 1.0, 0
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            words = set(re.findall(r"\w+", sentence))
            held = words & set(weight)
            plain += bool(words) and not held
            none *= 1 - 1 / (1 + np.exp(5.0 - sum(weight[w] for w in held))) if held else 1
        want = 1 - none * max((1 - 1 / (1 + np.exp(5.0))) ** plain, 1 - toxicity.PLAIN)
        assert abs(found[number].score - want) < 1e-9
    assert [len(found[i].offending) for i in range(1, 6)] == [1, 0, 0, 0, 1]


def test_length_alone_is_not_toxic(spark):
    clean = " ".join(f"{prose(i, 9)}." for i in range(20_000))
    rows, labels = toxic_rows(300)
    docs = documents(spark, [*rows, (9000, clean), (9001, clean + " You grunkle.")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, known)).where("doc_id >= 9000").collect()}
    assert found[9000].predicted == 0 and found[9001].predicted == 1 and len(found[9001].offending) == 1
    assert toxicity.scored(docs, toxicity.Model()).where("doc_id = 9000").first().score <= toxicity.PLAIN + 1e-12


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """A labelled id that very many rows repeat, equal or not, and labels without documents."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bags, counts: seen.append(len(bags)) or toxicity.Model())
    many, same, once = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    docs = documents(spark, [*((many, f"{prose(i, 9)}.") for i in range(600)), *((same, "The same text.") for _ in range(600)), (once, "Third text.")])
    known = spark.createDataFrame([(i, 1, i % 2) for i in (many, same, once, *range(5000, 5400))], "doc_id long, quality int, toxic int")
    toxicity.train(docs, known, sample=10)
    toxicity.train(docs, known, sample=10_000)
    assert seen == [10, 602]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies, accept?</div><!-- <p>no</p> -->
<article><h1>Title &amp; more</h1><p>First  paragraph, with <a href="/x">a link</a> and some&nbsp;words.<p>Second &lt;b&gt; paragraph,
on two lines.</p><blockquote>A quote stands here, too.</blockquote></article>
<aside class="sidebar"><p>Other stories that you may like</p></aside><div class="comments"><div class="comment"><p>First comment, with a long text, and with opinions, as ever.</p></div></div>
<form><label>Mail</label><input name="m"></form><footer>&copy; 2024 somebody</footer>"""


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    trees = html_text.model(pages)
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain text only"), (1, "u", PAGE), (None, "x", "<p"), (5, "y", "<article><p>Open <script>x"), (6, "z", "<!-- open")]
    table = spark.createDataFrame([(*r, "k", "t") for r in rows], "page_id long, url string, html string, key string, text string")
    found = html_text.extracted(table, trees).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    text = "Title & more\nFirst paragraph, with a link and some words.\nSecond <b> paragraph, on two lines.\nA quote stands here, too."
    assert [r.text for r in found if r.page_id == 1] == [text, text]
    assert [r.text for r in found if r.page_id in (2, 3, 6)] == ["", "", ""]
    assert html_text.extracted(table.limit(0), trees).count() == 0
    assert html_text.model(table.limit(0)).trees.depth == 4


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>x</title><meta charset=u><body><article><p>One.</p></article>", ["One."]),
    ("<html><head><title>x</title><p>One.</p>", ["One."]),
    ("<html><head><style>a</style><title>x</title></head><body><p>One.</p></body></html>", ["One."]),
    *((f"<article><p>One.</p><{x}>gone<p>Two.</p><p>Three.</p></article><p>Four.</p>", ["One.", "Two.", "Three.", "Four."]) for x in ("button", "select", "object", "noscript", "svg", "video")),
    ("<article><p>One.</p><div><button>gone</div><p>Two.</p></button><p>Three.</p></article>", ["One.", "Two.", "Three."]),
    ("<article><p>One <button>gone<p>gone</p><div>gone</div></button>and two.</p><svg><g><text>gone</text></g></svg><p>Three.</p></article>", ["One and two.", "Three."]),
    ("<p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn></math> stands.</p>", ["Here x=1 stands."]),
    ("<p>One.</p><script>gone<p>gone</p>", ["One."])])
def test_silent_elements_drop_nothing_else(html, want):
    assert [text for _, text in html_text.parse(html).texts] == want


def test_html_held_out_layouts():
    """Layouts drawn with another seed and other texts than those of training."""
    texts = [prose(i, 6 + i % 60) for i in range(300)]
    trees = html_text.train([f"<p>{t}</p>" for t in texts[:150]])
    draw, right = random.Random(12345), 0
    for _ in range(200):
        page = html_text.labelled(html_text.rendered(texts[150:], [t[:120] for t in texts[150:]], draw))
        want = "\n".join(text for node, text in page.texts if page.label[node] == "1")
        right += html_text.decode(page, trees.odds([page])[0]) == want
    assert right >= 160


@pytest.fixture(scope="module")
def trained():
    texts = [prose(i, 6 + i % 60) for i in range(150)]
    return html_text.train([f"<p>{t}</p>" for t in texts])


@pytest.mark.parametrize("around", ["%s", "<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul></nav>%s<footer>(c) me</footer>"])
@pytest.mark.parametrize("start", [
    'article class="side-effects"', 'article class="share-prices"', 'article class="advert-free"', 'article class="comment-piece"', 'div id="header-story"',
    'div class="social-science"', 'section class="form-of-government"', "article"])
def test_no_name_alone_empties_an_article(trained, start, around):
    body = "".join(f"<p>{prose(400 + i, 25)}</p>" for i in range(6))
    page = html_text.parse(around % f"<{start}><header><h1>The title</h1></header>{body}</{start.split()[0]}>")
    assert html_text.decode(page, trained.odds([page])[0]) == "\n".join(["The title", *(prose(400 + i, 25) for i in range(6))])


#: Layouts that the generator of training pages does not draw; M stands for a paragraph of main text, N for another text.
LAYOUTS = [
    "<table><tr><td class=left><a href=a>N</a><br><a href=b>N</a></td><td class=body><h1>M</h1><p>M</p><p>M</p><p>M</p></td></tr></table><div>N</div>",
    "<div id=top><ul><li><a href=a>N</a></li><li><a href=b>N</a></li></ul></div><div role=main><div class=row><div class=col><h1>M</h1><p>M</p><p>M</p><figure><figcaption>M</figcaption></figure><p>M</p></div></div></div><div role=contentinfo><p>N</p></div>",
    "<header><div><a href=a>N</a></div><nav><a href=a>N</a> <a href=b>N</a></nav></header><main><section><h2>M</h2><p>M</p></section><section><h2>M</h2><p>M</p><p>M</p></section></main><aside><h3>N</h3><p>N</p></aside>",
    "<div class=blog><div class=hentry><h1>M</h1><div class=copy><p>M</p><blockquote>M</blockquote><p>M</p><ul><li>M</li><li>M</li></ul></div></div><div id=comments><h3>N</h3><div class=comment-body><p>N</p></div><div class=comment-body><p>N</p></div></div></div>",
    "<article><p>M</p><div class=ad>N</div><p>M</p><p>M</p></article><section class=comments><article><p>N</p></article><article><p>N</p></article></section>",
    "<div><p>M</p><p>M</p><p>M</p><p>M</p></div><div><a href=a>N</a><a href=b>N</a><a href=c>N</a></div>",
]


def test_quality_on_layouts_that_are_not_drawn(trained):
    """Share of the characters kept that are main text, and of main text that is kept."""
    both = kept = main = 0
    for number in range(60):
        draw, parts = random.Random(number), []
        html = re.sub("[MN]", lambda m: parts.append((m.group(), prose(draw.randrange(10**6), draw.randint(25, 60) if m.group() == "M" else draw.randint(2, 12)))) or parts[-1][1], LAYOUTS[number % len(LAYOUTS)])
        page = html_text.parse(html)
        got = set(html_text.decode(page, trained.odds([page])[0]).split("\n")) - {""}
        want = {text for kind, text in parts if kind == "M"}
        both += sum(map(len, got & want))
        kept += sum(map(len, got))
        main += sum(map(len, want))
    print(both / kept, both / main)
    assert both / kept >= 0.95 and both / main >= 0.95


def test_decoding_has_no_contradictions():
    page = html_text.parse("<div><div><p>a</p><p>b</p></div><div><p>c</p></div></div>")
    draw = np.random.default_rng(0)
    for _ in range(200):
        odds = draw.normal(size=len(page.tag))
        kept = html_text.decode(page, odds, price=0.3).split("\n")
        assert set(kept) <= {"a", "b", "c", ""}
    assert html_text.decode(page, np.array([0, 0, -9, 1, 1, 5, 5.0])) == "c"


def test_decoding_is_the_best_of_all_choices():
    """Every state (none, all, mixture) of every node, where all and none bind what is below."""
    page = html_text.parse("<div>z<p>a</p><ul><li>b</li><li>c</li></ul></div><div>d</div>")
    n, draw = len(page.tag), np.random.default_rng(5)
    holds = {node for node, _ in page.texts}
    for _ in range(60):
        odds, price = draw.normal(size=n) * 2, float(draw.random())
        odds[0] = 0.0

        def value(states):
            total = 0.0
            for i, state in enumerate(states):
                above = states[page.parent[i]] if i else 2
                if above != 2 and state != above:
                    return None
                total += odds[i] if state == 1 else (max(odds[i], 0) if i in holds else 0) - price + min(0.0, odds[i]) if state == 2 else 0.0
            return total

        best = max((v, states) for states in itertools.product((0, 1, 2), repeat=n) if (v := value(states)) is not None)[1]
        want = "\n".join(t for node, t in page.texts if best[node] == 1 or (best[node] == 2 and odds[node] > 0))
        assert html_text.decode(page, odds, price) == want


def test_a_deep_and_a_long_page(trained):
    body = f"<p>{prose(1, 40)}</p>"
    deep = html_text.parse("<div>" * 3000 + body * 5 + "</div>" * 3000)
    assert len(html_text.decode(deep, trained.odds([deep])[0]).split("\n")) == 5
    long = html_text.parse("<nav><a href=x>Home</a></nav><article>" + body * 5000 + "</article>")
    assert html_text.decode(long, trained.odds([long])[0]) == "\n".join([prose(1, 40)] * 5000)


def test_boosting_fits_a_rule():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(2000, 5))
    label = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    trees = boost(rows[:1500], label[:1500])
    assert ((trees.score(rows[1500:]) > 0) == (label[1500:] > 0)).mean() > 0.95
