"""Small tables with everything that may go wrong in them, and plain re-computations."""

from __future__ import annotations

import re
from collections import Counter

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, n long, label int, h1 long, node long, hash long, size long, t1 long, part long"
#: Names that clash with those the operators use inside.
EXTRA = ("k", "r", 7, 1, 2, 3, 4, 5, 6, 9)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed: int, count: int) -> str:
    """Words that look random and differ by seed."""
    return " ".join(f"{WORDS[(seed * 7 + i * i * 13 + i * seed) % 24]}{(seed * 31 + i * 17) % 97}" for i in range(count))


def documents(spark, rows: list[tuple]):
    """(doc_id, text[, lang, source]) as a table of documents with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *EXTRA) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_texts() -> list[tuple]:
    """Nulls, empties, repeated rows, a text far longer than the rest, and text without words or blanks."""
    long = prose(5, 4000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, prose(1, 60)), (7, prose(1, 60)), (7, prose(1, 60)), (None, prose(2, 60)),
        (None, prose(2, 60)), (8, long), (9, long + " more"), (10, "x" * 5000), (11, "naïve café – 数据 здесь     end"), (12, prose(3, 80) + "\n" + prose(3, 80))]


def windows(text: str | None, size: int) -> list[tuple]:
    own = words(text)
    return [tuple(own[i : i + size]) for i in range(len(own) - size + 1)]


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    own, plain = words(text), text or ""
    lines = [x for x in plain.split("\n") if words(x)]
    three = windows(text, 3)
    count, covered = Counter(three), set()
    for i, x in enumerate(three):
        if count[x] > 1:
            covered.update((i, i + 1, i + 2))
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in plain), len(lines) - len(set(lines)), len(covered)


def removed(rows: list[tuple], size: int = 35) -> list[tuple]:
    """(id, n_words, n_removed, kept words) per row, by counting every window."""
    count = Counter(w for _, text, *_ in rows for w in windows(text, size))
    out = []
    for key, text, *_ in rows:
        own = words(text)
        gone = [False] * len(own)
        for i, w in enumerate(windows(text, size)):
            if count[w] > 1:
                gone[i : i + size] = [True] * size
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out.append((key, len(own), sum(gone), " ".join(kept)))
    return out


def links(texts: dict, threshold: float = 0.8) -> tuple[dict, dict]:
    """Links per id and class per id, comparing every pair."""
    sets = {k: set(windows(t, min(5, len(words(t)) or 1))) for k, t in texts.items()}
    count, parent = Counter(), {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * len(sets[a] | sets[b]):
                count[a] += 1
                count[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: count[k] for k in keys}, {k: root(k) for k in keys}
