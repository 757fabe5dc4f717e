"""Operators over the whole corpus: near copies, repeated passages, chats, vectors, components and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tablero.llm import chat_format, common, graph, jaccard_join, pivot_search, substring_dedup
from tablero.llm.common import table
from tablero.llm.fm_index import Index
from tests.llm.frames import SMALL, documents, links, odd_texts, prose, quality_counts, removed, words


def near_copies() -> list[tuple]:
    """Groups of copies with ever more words changed, chains, and a large group."""
    rows = []
    for g in range(12):
        base = words(prose(g + 40, 80))
        for i in range(8):
            own = list(base)
            for j in range(i):
                own[(j * 9 + i) % len(own)] = f"changed{g}{i}{j}"
            rows.append((g * 100 + i, " ".join(own)))
    base = words(prose(77, 90))
    rows += [(5000 + i, " ".join([*base[:-1], f"last{i}"])) for i in range(60)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    count, root = links(dict(rows))
    found = {r.doc_id: r for r in jaccard_join.joined(documents(spark, rows).repartition(3)).collect()}
    assert {k: (r.n_links, r.class_id) for k, r in found.items()} == {k: (count[k], root[k]) for k in count}


def test_jaccard_join_odd_rows(spark):
    found = jaccard_join.joined(documents(spark, odd_texts())).collect()
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in found)
    assert got == Counter([
        (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 2), (7, 6, 2), (7, 6, 2), (None, None, 0), (None, None, 0), (8, 8, 1), (9, 8, 1), (10, 10, 0), (11, 11, 0), (12, 12, 0)])
    assert jaccard_join.joined(documents(spark, [])).count() == 0


def test_pruning_bound():
    least = jaccard_join.least_equal(0.8, 1e-6)
    assert list(least) == list(range(16, 97, 16)) and all(0 < m < 0.8 * n for n, m in least.items())
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(500, 510, dtype=np.uint64)]
    left, right = np.array([0, 0, 1] * 5), np.array([1, 2, 2] * 5)
    assert jaccard_join.intersections(sets, left, right).tolist() == [90, 0, 0] * 5


def passages() -> list[tuple]:
    shared = [prose(900 + i, 60) for i in range(3)]
    rows = [(i, f"{prose(i, 45)} {shared[i % 3]} {prose(i + 300, 50)}") for i in range(40)]
    rows += [(100 + i, prose(i + 600, 34 + i)) for i in range(6)]
    return rows + [(200, "again " * 90), (201, prose(1, 34) + " " + prose(950, 35) + " x " + prose(950, 35)), (202, shared[0]), (203, prose(910, 35)), (204, "pre " + prose(910, 35))]


@pytest.mark.parametrize("hot, shard", [(2048, 400_000), (2, 50)])
def test_substring_dedup(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rows = [*odd_texts(), *passages()]
    found = substring_dedup.removed(documents(spark, rows).repartition(3)).collect()
    want = Counter((k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in removed(rows))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == want
    assert substring_dedup.removed(documents(spark, [])).count() == 0


@pytest.mark.parametrize("stretch", [1, 40, 1 << 21])
def test_words_are_hashed_and_anchored_in_bulk(monkeypatch, stretch):
    """Many texts at once give each word its own hash, each text its digest, and each window the first smallest gram, as text by text."""
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    draw = random.Random(8)
    texts = ["", " ", "a", " b\tc\n", "\x00 \x00\x00 ab\x00 ab", "é　ü x\x1cy", "12345678 123456789", *(" ".join("w" * n for n in (511, 512, 513, 520)) for _ in range(2)), "again " * 90]
    texts += ["".join(draw.choice("ab é\n\t\x0b\x0c\r\x1f\x00 ") for _ in range(draw.randint(0, 600))) for _ in range(60)] + ["x " * 34 + "x"]
    seen, at = {}, 0
    for start, found in substring_dedup.stretches(pa.array(texts)):
        hashes, anchors = found.hashes(), {}
        assert start == at
        for owner, first, windows, anchor in zip(*(x.tolist() for x in substring_dedup.elected(hashes, found.counts)), strict=True):
            anchors.update({(owner, first + i): anchor for i in range(windows)})
        for i, (own, digest) in enumerate(zip(np.split(hashes, found.ends[:-1]), found.digests(), strict=True)):
            plain = common.words_of(texts[at])
            assert found.counts[i] == len(own) == len(plain) and digest == substring_dedup.kept_digest(plain)
            assert all(seen.setdefault(word, value) == value for word, value in zip(plain, own.tolist()))
            spread, factors = substring_dedup.mixed(own), substring_dedup.GRAM_FACTORS
            grams = [int(substring_dedup.mixed((spread[j : j + 8] * factors).sum(keepdims=True))[0]) for j in range(len(own) - 7)]
            want = {(i, j): min(grams[j : j + 28]) for j in range(len(own) - 34)}
            assert {k: v for k, v in anchors.items() if k[0] == i} == want
            at += 1
    assert at == len(texts) and len(set(seen.values())) == len(seen) > 100


def test_copies_pass_through_the_index(spark, monkeypatch):
    """Texts whose only repetition is their copies, a repeated id among them, and heavy keys joined apart."""
    monkeypatch.setattr(common, "FEW", 3)
    monkeypatch.setattr(common, "PARTS", 50)
    rows = [(i, prose(i // 7 + 50, 120)) for i in range(28)] + [(90, prose(70, 80))] * 3 + [(None, prose(71, 80))] * 2 + [(91, prose(72, 300)), (92, prose(50, 34))]
    _, changed = substring_dedup.stages(documents(spark, rows))
    assert changed.count() == 6 and changed.where("n_removed > 0 AND kept = ''").count() == 6
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(documents(spark, rows).repartition(3)).collect())
    assert found == Counter((k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in removed(rows))
    assert substring_dedup.cleaned_documents(documents(spark, rows)).where("text = ''").count() == 33


def test_cleaned_documents(spark):
    rows = passages()
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in substring_dedup.cleaned_documents(docs).collect()}
    assert substring_dedup.cleaned_documents(docs).columns == docs.columns
    texts = dict(rows)
    for key, _, gone, kept in removed(rows):
        assert found[key].text == (kept if gone else texts[key]) and found[key].n_chars == len(found[key].text) and found[key].key == "k"


def test_full_text_index():
    draw = np.random.default_rng(5)
    text = np.concatenate([draw.integers(1, 5, 3000), [0], draw.integers(1, 4, 2000), [0], np.full(200, 2), [0]])
    index = Index(text)
    plain = text.tolist()
    for length in (1, 2, 5, 11, 40):
        for start in draw.integers(0, len(text) - length, 60).tolist():
            pattern = plain[start : start + length]
            if 0 in pattern:
                continue
            low, high = np.array([0]), np.array([len(text)])
            for symbol in reversed(pattern):
                low, high = index.back(np.array([symbol]), low, high)
            assert high[0] - low[0] == sum(plain[i : i + length] == pattern for i in range(len(plain) - length + 1))
    heavy = Index(np.array([1, 2, 3, 4, 0, 2, 3, 5, 0]), np.array([3, 3, 3, 3, 3, 1, 1, 1, 1]))
    line = np.array([1, 2, 3, 5])
    assert [heavy.matches(line, np.arange(4), 3, least).tolist() for least in (1, 2, 4, 5)] == [[1, 2, 3, 3], [1, 2, 3, 0], [0, 1, 2, 0], [0, 0, 0, 0]]
    ends = np.array([i for i in range(50, 2900) if 0 not in plain[i - 34 : i + 1]])
    found = index.matches(text, ends, 35)
    for i in range(0, len(ends), 97):
        longest = 0
        while longest < 35 and sum(plain[j : j + longest + 1] == plain[ends[i] - longest : ends[i] + 1] for j in range(len(plain) - longest)) >= 2:
            longest += 1
        assert found[i] == longest


def test_components(spark):
    draw = random.Random(9)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def logs() -> list[tuple]:
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "how?"), ("assistant", None), ("user", "bye")]
    rows = [(conv, turn, *turns[turn], "x") for conv, size in ((1, 2), (2, 4), (3, 5), (4, 5), (5, 1)) for turn in range(size)]
    rows += [(6, 0, "user", "hi", "x"), (6, 1, "assistant", "other", "x"), (7, 0, "user", "hi", "x"), (7, 0, "user", "hi", "x"), (None, 0, "user", "alone", "x")]
    rows += [(8, None, None, None, "x"), (8, 3, "a", "b", "x"), (9, 3, "a", "b", "x"), (10, 1, "assistant", "hello", "x"), (10, 0, "user", "hi", "x")]
    return rows + [(50, i, "user", f"turn {i}", "x") for i in range(200)] + [(51, i, "user", f"turn {i}", "x") for i in range(150)] + [(52, i, "user", f"turn {i}", "x") for i in range(130)] + [(52, 130, "user", "off", "x")]


def test_chat_format(spark):
    frame = spark.createDataFrame(logs(), "conv_id long, turn long, role string, text string, run string")
    found = chat_format.collapsed(frame)
    assert {r.conv_id for r in found.collect()} == {3, 6, 8, 9, 50, 52, None}
    con = duckdb.connect()
    conversations = frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", conversations)
    want = con.execute(chat_format.SQL)
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, found.select(*names).collect())) == Counter(want.fetchall())
    whole = "".join(r.rendered for r in sorted((r for r in found.collect() if r.conv_id == 3), key=lambda r: r.start))
    assert whole.startswith("<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n") and whole.count("<|end|>") == 5
    assert chat_format.collapsed(frame.limit(0)).count() == 0


def test_chat_format_stays_in_the_jvm(spark):
    plan = contract.queries()["op2_chat_format"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def vectors() -> list[tuple]:
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(700)]
    same = rows[100][1]
    rows += [(1000 + i, same) for i in range(120)]
    return rows + [(2000, None), (2100, []), (2200, [1.0, None]), (2300, [float("nan")] * 8), (2400, [float("inf")] * 8), (2500, [0.5, 0.25]), (None, same), (2600, [0.0] * 8), (2700, [3e30] + [0.0] * 7)]


@pytest.mark.parametrize("rounds", [(0, 12), (0,), (0, 1, 1)])
def test_pivot_search(spark, monkeypatch, rounds):
    monkeypatch.setattr(pivot_search, "BLOCK", 60)
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "vec_id long, embedding array<float>, label int, vec string")
    from pyspark.sql import functions as F

    found = pivot_search.search(frame, F.col("id") % 100 == 0, pivots=9, rounds=rounds).collect()
    usable = {k: [max(-(2**62), min(2**62, int(np.floor(float(np.float32(x)) * 1024)))) for x in v] for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [k for k in usable if k % 100 == 0]:
        score = {k: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, usable[q], strict=False)))) for k, v in usable.items() if k != q}
        want = sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want, q
    assert len(found) == 10 * sum(k % 100 == 0 for k in usable)
    assert pivot_search.search(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    few = pivot_search.search(frame.where("vec_id in (0, 1, 2)"), F.col("id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("key", sorted(contract.llm.oracle_sql()))
def test_queries_against_sql(spark, key):
    con = duckdb.connect()
    for name in ("conversations", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    want = con.execute(contract.oracle_sql()[key])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, contract.queries()[key](spark, SMALL).select(*names).collect())) == Counter(want.fetchall())


def test_all_queries_and_the_pipeline_are_registered():
    names = contract.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)) and "pipeline" in names


def test_nothing_else_imports_the_package():
    root = Path(contract.__file__).parent
    rest = [p for p in (root / "tablero").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert rest and not any("tablero.llm" in p.read_text() for p in rest)


def test_pipeline(spark):
    """Each stage against brute force on the rows that the one before left."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs]
    rows += [(None, prose(70, 90), "en", "s1"), (90001, None, "en", "s1"), (90002, prose(71, 90), "en", "s1"), (90002, prose(71, 90), "en", "s1"), (90003, prose(71, 90) + " end", None, None)]
    now = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "substring dedup", "best-fit packing"]

    good = stages["quality rules"](spark, now, SMALL)
    assert good.columns == now.columns
    left = [(r.doc_id, r.text) for r in good.collect()]
    failed = [(r[0], r[1]) for r in rows if (c := quality_counts(r[1]))[0] < 50 or 100 * c[4] > 50 * c[0]]
    assert not Counter(left) & Counter(failed) and len(left) + len(failed) <= len(rows) and len(left) > 0.6 * len(rows)
    assert Counter(left)[90002, prose(71, 90)] == 2 and Counter(left)[None, prose(70, 90)] == 1

    mild = stages["toxicity"](spark, good, SMALL)
    assert mild.columns == now.columns
    calm = [(r.doc_id, r.text) for r in mild.collect()]
    assert not Counter(calm) - Counter(left)

    single = stages["n-gram Jaccard join"](spark, mild, SMALL)
    assert single.columns == now.columns
    _, root = links({(k if k is not None else -1): t for k, t in calm})
    kept = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in single.collect())
    assert kept == sorted({((k if k is not None else -1), t) for k, t in calm if root[k if k is not None else -1] == (k if k is not None else -1)})

    bare = stages["substring dedup"](spark, single, SMALL)
    texts = {k: t for k, t in kept}
    want = {k: (body if gone else texts[k]) for k, _, gone, body in removed(kept)}
    assert {(r.doc_id if r.doc_id is not None else -1): r.text for r in bare.collect()} == want and bare.columns == now.columns

    assert stages["best-fit packing"](spark, bare, SMALL).select("doc_id").distinct().count() == len(want)
