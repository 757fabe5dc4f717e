"""Aligned tokens, spelling variants and repeated lines against plain re-computations."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablero.llm import alignment, line_dedup, spelling
from tablero.llm.common import table
from tests.llm.frames import SMALL, documents, odd_texts

A, B = (public_tokenizers.path(name) for name in (alignment.BYTE_BPE, alignment.PIECES))


def small_rows(spark) -> list[tuple]:
    return [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]


# Lines


def clean_lines(rows: list[tuple], least: int = 10) -> list[tuple]:
    """(id, lines, dropped, kept text) per row; a null id is a document after all others."""
    holders: dict[str, set] = {}

    def key_of(line: str) -> str | None:
        own = line.strip(" \t\n\v\f\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), own) if len(own) >= least else None

    def rank(name) -> tuple:
        return name is None, name or 0

    for name, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(rank(name))
    out = []
    for name, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) is None or min(holders[key_of(x)]) == rank(name)]
        out.append((name, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lined() -> list[tuple]:
    """A line of a third of all documents, lines that differ in case and blanks only, short ones, repeats inside a document and of a whole row."""
    rows = [(i, f"own line number {i}\n  Shared Line of many \nshort\n" + ("shared line of many\n" * (i % 3)) + f"pair {i // 2} of two lines") for i in range(60)]
    rows += [(5, "own line number 5\nsomething else here"), (5, "own line number 5\nsomething else here"), (None, "SHARED LINE OF MANY\nnobody else has this\nnobody else has this")]
    rows += [(None, "nobody else has this"), (100, None), (101, ""), (102, "\n\n"), (103, "ÄÖÜ straße line\nsome more text"), (104, "äÖÜ straße line\nÄÖÜ STRAßE LINE"), (105, "123456789 \n" * 3)]
    return rows + [(106, "\n".join(f"line of a long text {i % 700}" for i in range(3000))), (90, "line of a long text 3 "), (91, "line of a long text 4\r")]


@pytest.mark.parametrize(("shard", "block"), [(1 << 14, 1 << 18), (8, 200)])
def test_line_dedup(spark, monkeypatch, shard, block):
    monkeypatch.setattr(line_dedup, "SHARD", shard)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = lined()
    got = line_dedup.cleaned(documents(spark, rows).repartition(7))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, got.collect())) == Counter(clean_lines(rows))
    digests = line_dedup.digests(documents(spark, rows)).collect()
    assert Counter(r.kept_sha256 for r in digests) == Counter(hashlib.sha256(k.encode()).hexdigest() for *_, k in clean_lines(rows))


def test_line_dedup_odd_rows(spark):
    rows = odd_texts()
    assert Counter(map(tuple, line_dedup.cleaned(documents(spark, rows)).collect())) == Counter(clean_lines(rows))
    empty = line_dedup.digests(documents(spark, rows).limit(0))
    assert empty.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and empty.count() == 0
    only = [(1, None), (2, "")]
    assert Counter(map(tuple, line_dedup.cleaned(documents(spark, only)).collect())) == Counter(clean_lines(only))
    named = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string"))
    want = [(None if k is None else str(k), t) for k, t in rows]
    got = line_dedup.cleaned(named).collect()
    assert sum(r.n_dropped for r in got) == sum(x[2] for x in clean_lines([(k and int(k), t) for k, t in want]))


def test_line_dedup_whole_table(spark):
    rows = small_rows(spark)
    assert Counter(map(tuple, line_dedup.cleaned(table(spark, SMALL, "documents")).collect())) == Counter(clean_lines(rows))


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(count):
    draw = np.random.default_rng(count)
    h1, h2 = (draw.integers(0, 2**64, count, dtype=np.uint64) for _ in range(2))
    h1[: count // 2] = 7  # pairs that share one number
    own = line_dedup.PerfectHash.unpacked(*line_dedup.PerfectHash.of(h1, h2).packed())
    assert sorted(own.places(h1, h2).tolist()) == list(range(count))
    others = own.places(*(draw.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2)))
    assert ((others >= -1) & (others < max(count, 1))).all()


def test_perfect_hash_refuses_repeated_pairs():
    with pytest.raises(ValueError, match="twice"):
        line_dedup.PerfectHash.of(np.array([3, 3], dtype=np.uint64), np.array([4, 4], dtype=np.uint64))


# Spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows: list[tuple]) -> dict[str, tuple]:
    """Per word its form, root, count, number of near words and the form's count, comparing every pair."""
    count: Counter[str] = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if not (h := crc32(f"{'' if name is None else name}:{run}".encode())) % 97:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 5
    n = {w: c for w, c in count.items() if c >= 3}
    near: dict[str, list] = {w: [] for w in n}
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found_variants(df) -> dict[str, tuple]:
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def written_words() -> list[tuple]:
    """Many words that differ little, with counts that make long paths of forms, ties, accents, and one very long word."""
    draw = random.Random(8)
    base = ["colour", "color", "colors", "colours", "aaaaa", "aaaaaa", "aaaaaaa", "abcde", "bcdea", "naïve", "naive", "größe", "grösse", "×÷×÷×", "letter", "lettre"]
    base += ["".join(draw.choice("abé") for _ in range(draw.randint(4, 8))) for _ in range(250)]
    path = [("path" + "a" * i + "b" * (6 - i), 3 * 2**i) for i in range(7)]
    bag = [w for w in base for _ in range(draw.choice((1, 3, 3, 6, 7, 20)))] + [w for w, n in path for _ in range(n)] + ["x" * 3000, "x" * 3001] * 4
    draw.shuffle(bag)
    return [(i, draw.choice([" ", ", ", "1", "-", "数"]).join(bag[i * 40 : i * 40 + 40]).replace("c", draw.choice("cC"))) for i in range(len(bag) // 40 + 1)]


@pytest.mark.parametrize(("parts", "signed"), [(3, 4096), (5, 7)])
def test_spelling_variants(spark, monkeypatch, parts, signed):
    monkeypatch.setattr(spelling, "PARTS", parts)
    monkeypatch.setattr(spelling, "SIGNED", signed)
    rows = written_words() + [(None, "Colour COLOUR colour"), (None, "colour"), (3, None), (3, ""), (7, "tab\tnew")]
    want = variants(rows)
    assert found_variants(spelling.grouped(documents(spark, rows))) == want
    assert sum(x[0] is not None for x in want.values()) > 50 and max(x[3] for x in want.values()) >= 5


def test_spelling_long_paths_end_in_one_root(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)] + [("x", "y")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.rooted(forms).collect()} == {(f"w{i:02}", "w37") for i in range(37)} | {("x", "y")}


def test_spelling_odd_rows(spark):
    rows = odd_texts()
    assert found_variants(spelling.grouped(documents(spark, rows))) == variants(rows)
    assert spelling.grouped(documents(spark, rows).limit(0)).count() == 0


def test_spelling_one_letter_per_hundred_runs_is_lost():
    runs = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}".encode() for i in range(676)]
    changed = [r for r in runs if spelling.spelled(r, crc32(b"4:")) != r]
    assert changed and all(len(spelling.spelled(r, crc32(b"4:"))) == 5 and crc32(b"4:" + r) % 97 == 0 for r in changed)


# Alignment


def plain_alignment(rows: list[tuple]) -> dict:
    """Per row number the counts and the groups, walking along both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    own = alignment.tokenizers(A, B)
    count: Counter = Counter()
    out = []
    for name, text in rows:
        raw = b" " + (text or "").encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        if not text or b"".join(own.bytes_a[i] for i in a) != raw or b"".join(own.bytes_b[i] for i in b) != raw:
            out.append((name, 0, 0, [], []))
            continue
        cover_a, cover_b = ([k for k, i in enumerate(ids) for _ in sizes[i]] for ids, sizes in ((a, own.bytes_a), (b, own.bytes_b)))
        links = sorted(set(zip(cover_a, cover_b, strict=True)))
        ends_a, ends_b = ({p + 1 for p in range(len(raw)) if p + 1 == len(raw) or c[p] != c[p + 1]} for c in (cover_a, cover_b))
        groups, start = [], 0
        for end in sorted(ends_a & ends_b):
            groups.append(",".join(str(a[k]) for k in sorted(set(cover_a[start:end]))) + "|" + ",".join(str(b[k]) for k in sorted(set(cover_b[start:end]))))
            start = end
        pairs = [(a[x], b[y]) for x, y in links]
        count.update(pairs)
        out.append((name, len(a), len(b), groups, pairs))
    best: Counter = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((name, na, nb, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for name, na, nb, g, p in out)


@pytest.mark.parametrize(("size", "links"), [(1 << 14, 1 << 21), (3, 50)])
def test_alignment(spark, monkeypatch, size, links):
    monkeypatch.setattr(alignment, "LAID", 20 * size)
    monkeypatch.setattr(alignment, "LINKS", links)
    plain = alignment.merged
    monkeypatch.setattr(alignment, "merged", lambda a, b: plain(a, b, size))
    odd = ["<|endoftext|> and <s>", "a ▁ sign", " two  blanks\ttab\n\nlines ", "x" * 3000, " x‍", "é é ﬁ Ⅳ", "数据 😀 naïve", "\x00\x7f", "a", " ", "▁", "1234567890 3.14"]
    rows = odd_texts() + [(50 + i, x) for i, x in enumerate(odd)]
    own = documents(spark, rows).repartition(3)
    got = alignment.aligned(own, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows)
    assert alignment.aligned(own, A, B, spell=False).columns == got.columns[:-1]
    assert alignment.aligned(own.limit(0), A, B).count() == 0


def test_alignment_whole_table(spark):
    rows = small_rows(spark)
    assert Counter(map(tuple, alignment.aligned(table(spark, SMALL, "documents"), A, B).collect())) == plain_alignment(rows)


def test_merge_paths_divide_evenly():
    draw = np.random.default_rng(5)
    for size in (1, 2, 7, 64):
        a, b = (np.unique(np.append(draw.integers(1, 400, n), 400)) for n in (150, 90))
        i, j = alignment.diagonals(a, b, size)
        assert (np.diff(i + j)[:-1] == size).all() and (i[-1], j[-1]) == (len(a), len(b))
        links_a, links_b, groups_a, groups_b = alignment.merged(a, b, size)
        cover = {(int(np.searchsorted(a, p)), int(np.searchsorted(b, p))) for p in range(1, 401)}
        assert set(zip(links_a.tolist(), links_b.tolist(), strict=True)) == cover and len(links_a) == len(cover)
        assert a[groups_a - 1].tolist() == b[groups_b - 1].tolist() == sorted(set(a) & set(b))
    assert [len(x) for x in alignment.merged(a[:0], b[:0])] == [0] * 4


def test_ids_of_a_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(A)
    model.encode_special_tokens = True
    own = alignment.tokenizers(A, B).encode_a
    points = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" a{x}b {x} 1{x}2{x}{x} {x}'s .{x}." for x in map(chr, points)]
    assert [x.ids for x in model.encode_batch(texts, add_special_tokens=False)] == [own.encode_ordinary(x) for x in texts]
