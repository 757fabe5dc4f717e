"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is read into its block elements (inline tags only count as links). Each node gets features: its tag, what its attribute tokens (class, id,
role and tag, hashed) and those above it stood for in training, depth, place, characters, link share and text density of its subtree, and how it
compares with its siblings. No list of names decides anything. Boosted trees give each node the log-odds of main text. Decoding then chooses for every subtree the best of three: all text,
none, or a mixture decided by the children at a small price and against the evidence that the node itself is no text; so no kept block stands
below a dropped one and no dropped block below a kept one.

The model is trained here. Pages carry no labels, so training pages are rendered: blocks of text from at most ``SAMPLE`` given pages (those with
the smallest digests, up to ``LONGEST`` characters each) are put into layouts drawn at random, with known main text and known menus, headers, notices,
adverts, sidebars, forms, comments and footers. Names vary, are partly left out, and partly mislead: main text also goes under words of the page and under
names joined with those of other areas, and the other way round, so that the trees learn shape as well as names. One half of the training pages tells what
a token stands for, the other half trains the trees on it. Extraction is one pass over whole pages.

Results for odd input: a null or empty page, and one without main text, give the empty text. Broken markup is read as far as it goes: open
elements end with their parent, stray end tags are ignored, an open comment, script or other raw text runs to the end. The tags of
the head are passed over, since its elements hold no text of their own: it needs no end tag. Other silent elements (a button, say) go up to their
end tag inside the same parent; one that has none there ends with its parent or before the next block. Formulas are kept as text. Repeated rows and null ids give one
result row each. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablero.llm.boosting import Trees, boost
from tablero.llm.common import sampled

#: Pages that training takes text from, their length at most, rendered pages, and the seed of the layouts.
SAMPLE, LONGEST, RENDERED, SEED = 200, 200_000, 1200, 7
#: Log-odds that a mixture costs a subtree.
PRICE = 0.5

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+|\d")
#: Elements whose content is no page text: raw text, which only its end tag ends, and those that hold markup.
RAW = frozenset("script style title textarea iframe noframes".split())
SILENT = frozenset("template noscript svg canvas object select button audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
#: A new element of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GROUPS = {
    "main": "article main", "menu": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset dialog", "section": "section",
    "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl li dt dd", "table": "table tbody thead tr td th caption", "div": "div center", "quote": "blockquote pre figure figcaption address",
}
GROUP = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags.split()}
#: Attribute tokens are hashed into so many cells.
CELLS = 1 << 14
#: Elements and names of the areas of training pages: main text first.
MAIN = ["article", "article post", "main", "div content", "div entry-content", "section article-body", "div main", "div story", "div post-text", "div page-content", "section", "div"]
AREAS = {
    "menu": ["nav", "div menu", "ul nav", "div navbar", "nav main-nav", "div navigation", "div toolbar", "div pagination"],
    "header": ["header", "div header", "div masthead", "header page-header", "div top-banner"],
    "notice": ["div cookie-notice", "div alert", "div banner", "section notice", "div gdpr-consent", "div popup", "div modal", "div newsletter", "div subscribe"],
    "advert": ["div ad", "div ads", "div sponsored", "aside promo", "section advert", "div advertisement"],
    "trail": ["div breadcrumb", "ol breadcrumbs"],
    "side": ["aside", "div sidebar", "aside widget", "div related", "div recommended", "div complementary"],
    "form": ["form", "form search", "form login", "form signup"],
    "comments": ["section comments", "div comments", "div comment-list", "ol comments", "div discussion", "div replies"],
    "footer": ["footer", "div footer", "footer page-footer", "div copyright", "div contentinfo"],
    "inner": ["div ad", "div share social", "aside related", "div newsletter signup", "div tags"],
}

@dataclass
class Page:
    """Block elements in page order; 0 is the page itself. Texts are (node, text) in page order."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    label: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=lambda: [0])


def raw_end(html: str, name: str, at: int) -> int:
    """Where raw text that begins here is over, its end tag included."""
    close = re.compile(rf"</{re.escape(name)}(?:[\s/>]|\Z)", re.I).search(html, at)
    return (html.find(">", close.start()) + 1 if close else 0) or len(html)


def silent_ends(html: str) -> dict[int, int]:
    """Where each silent element begins that has an end tag inside its parent, and where it is over."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    found = TAG.search(html)
    while found:
        at, end, name = found.end(), found.group(1), (found.group(2) or "").lower()
        if name in RAW:
            at = at if end or found.group(3).rstrip().endswith("/") else raw_end(html, name, at)
        elif not name or name in INLINE or name in VOID:
            pass
        elif not end:
            if name not in SILENT or not found.group(3).rstrip().endswith("/"):
                stack.append((name, found.start()))
                opened[name] += 1
        # The end of a paragraph does not reach out of a silent element.
        elif opened[name] and not (name == "p" and next(x for x, _ in reversed(stack) if x == "p" or x in SILENT) != "p"):
            while stack:
                last, start = stack.pop()
                opened[last] -= 1
                if last == name:
                    if name in SILENT:
                        ends[start] = at
                    break
        found = TAG.search(html, at)
    return ends


def parse(html: str) -> Page:
    """The block elements and texts of a page."""
    page, stack, at, link, mute = Page(), [0], 0, False, False
    held: list[str] = []
    ends: dict[int, int] | None = None

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                page.texts.append((stack[-1], text))
            held.clear()

    found = TAG.search(html)
    while found:
        if found.start() > at and not mute:
            held.append(html[at : found.start()])
            if link:
                page.linked[stack[-1]] += found.start() - at
        at = found.end()
        end, name = found.group(1), found.group(2)
        if name is not None:
            name = name.lower()
            if name == "a":
                link = not end
            elif name == "br":
                held.append(" ")
            elif name in RAW:
                if not end and not found.group(3).rstrip().endswith("/"):
                    at = raw_end(html, name, at)
            elif name in SILENT:
                if not end and not found.group(3).rstrip().endswith("/"):
                    ends = silent_ends(html) if ends is None else ends
                    mute |= found.start() not in ends
                    at = ends.get(found.start(), at)
            elif name == "head":
                flush()
            elif name not in INLINE and not (mute and not end and name not in GROUP):
                flush()
                link = False
                mute &= not (name in GROUP or any(page.tag[x] == name for x in stack[1:]))
                if end:
                    for depth in range(len(stack) - 1, 0, -1):
                        if page.tag[stack[depth]] == name:
                            del stack[depth:]
                            break
                elif name not in VOID:
                    if page.tag[stack[-1]] == "p" or page.tag[stack[-1]] in ENDS.get(name, ()):
                        stack.pop()
                        if page.tag[stack[-1]] in ENDS.get(name, ()):
                            stack.pop()
                    own = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(found.group(3))} if found.group(3) else {}
                    page.tag.append(name)
                    page.parent.append(stack[-1])
                    page.names.append(" ".join(own.get(k, "") for k in ("class", "id", "role")).lower() if own else "")
                    page.label.append(own.get("data-y", ""))
                    page.linked.append(0)
                    stack.append(len(page.tag) - 1)
        found = TAG.search(html, at)
    if not mute:
        held.append(html[at:])
    flush()
    return page


def cells(tag: str, names: str) -> list[int]:
    """Cells of an element's attribute tokens and tag."""
    found = {f"<{tag}", *TOKEN.findall(names)} if names else {f"<{tag}"}
    return [crc32(x.encode()) % CELLS for x in found]


def evidence(pages: list[Page]) -> np.ndarray:
    """Per cell the log-odds that an element with such a token is main text, from labelled pages; near 0 for tokens that are rare or on both sides."""
    seen = np.zeros((2, CELLS))
    for page in pages:
        for i, y in enumerate(page.label):
            if y:
                seen[int(y), cells(page.tag[i], page.names[i])] += 1
    total = seen.sum(axis=1) + 1
    return np.log(seen[1] / total[1] + 0.002) - np.log(seen[0] / total[0] + 0.002)


def features(page: Page, known: np.ndarray) -> np.ndarray:
    """A row per node; ``known`` is what tokens stand for."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, stops = np.zeros(n), np.zeros(n)
    for node, text in page.texts:
        own[node] += len(text)
        stops[node] += text.count(".") + text.count(",")
    chars, links, marks, size, depth = own.copy(), np.array(page.linked, dtype=float), stops, np.ones(n), np.zeros(n)
    ahead = np.cumsum(own) - own
    group = np.array([GROUP.get(tag, -1) for tag in page.tag])
    # Of the tokens of an element: the lowest, the highest, their sum; and the lowest and highest sum from the page down to it.
    low, high, told, worst, top = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    children = np.zeros(n)
    order = np.zeros(n)
    memo: dict[tuple[str, str], tuple[float, float, float]] = {}
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        order[i] = children[p]
        children[p] += 1
        name = (page.tag[i], page.names[i])
        if name not in memo:
            found = known[cells(*name)]
            memo[name] = float(found.min()), float(found.max()), float(found.sum())
        low[i], high[i], told[i] = memo[name]
        worst[i], top[i] = min(worst[p], told[i]), max(top[p], told[i])
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        size[p] += size[i]
    log = np.log1p(chars)
    up = np.maximum(parent, 0)
    sums = np.bincount(up[1:], weights=log[1:], minlength=n)
    siblings = np.maximum(children[up], 1)
    same = np.zeros(n)
    count: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        key = (page.parent[i], page.tag[i])
        count[key] = count.get(key, 0) + 1
    for i in range(1, n):
        same[i] = count[page.parent[i], page.tag[i]]
    flags = np.zeros((n, len(GROUPS)))
    flags[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    above = group[up]
    columns = [
        low, high, told, worst, top, worst[up], above, depth, ahead / max(1.0, chars[0]), log, np.log1p(own), links / np.maximum(chars, 1), chars / size, children, order / siblings, siblings,
        sums[up] / siblings - log, same / siblings, marks / np.maximum(chars, 1), chars / max(1.0, chars[0])]
    return np.concatenate([flags, np.stack(columns, axis=1)], axis=1)


def decode(page: Page, odds: np.ndarray, price: float = PRICE) -> str:
    """The text of the kept blocks: per subtree all, none, or a mixture of its children's choices."""
    n = len(page.tag)
    filled = np.zeros(n, dtype=bool)
    holds = np.zeros(n, dtype=bool)
    for node, _ in page.texts:
        filled[node] = holds[node] = True
    for i in range(n - 1, 0, -1):
        filled[page.parent[i]] |= filled[i]
    odds = np.where(filled, odds, 0.0)
    odds[0] = 0.0
    whole, mixed = odds.copy(), np.where(holds, np.maximum(odds, 0), 0.0)
    best, choice = np.zeros(n), np.zeros(n, dtype=np.int8)
    for i in range(n - 1, -1, -1):
        mixture = mixed[i] - price + min(0.0, odds[i])
        best[i] = max(0.0, whole[i], mixture)
        choice[i] = 1 if whole[i] == best[i] and best[i] > 0 else 2 if mixture == best[i] and best[i] > 0 else 0
        if i:
            whole[page.parent[i]] += whole[i]
            mixed[page.parent[i]] += best[i]
    keep = np.zeros(n, dtype=np.int8)
    for i in range(n):
        above = keep[page.parent[i]] if i else 2
        keep[i] = choice[i] if above == 2 else above
    return "\n".join(text for node, text in page.texts if keep[node] == 1 or (keep[node] == 2 and odds[node] > 0))


def rendered(main: list[str], other: list[str], draw: random.Random) -> str:
    """A page in a layout drawn at random; data-y marks main text (1) and the rest (0)."""
    def words(low: int, high: int) -> str:
        return " ".join(draw.choice(other).split()[: draw.randint(low, high)]) or "more"

    def strange() -> str:
        found = TOKEN.findall(words(1, 3).lower())
        return found[0] if found else "x"

    def named(kinds: list[str], inner: str, y: int) -> str:
        tag, _, name = draw.choice(kinds).partition(" ")
        across = draw.choice(draw.choice([MAIN, *AREAS.values()])).split(" ")[-1]
        if draw.random() < 0.3:
            name = draw.choice([strange(), f"{across}-{strange()}", f"{strange()}-{across}", f"{name or tag}-{across}" if not y else f"{across}-{strange()}"])
        shown = f' {draw.choice(["class", "id"])}="{name}"' if name and draw.random() < 0.85 else ""
        return f'<{tag}{shown} data-y="{y}">{inner}</{tag}>'

    def links() -> str:
        items = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(draw.randint(3, 9)))
        return f"<ul>{items}</ul>" if draw.random() < 0.8 else items.replace("li>", "div>")

    def lines(source: list[str], low: int, high: int) -> str:
        return "".join(f"<{(t := draw.choice(['p', 'p', 'div']))}>{draw.choice(source)}</{t}>" for _ in range(draw.randint(low, high)))

    count = draw.choice([1, 2, 3, 5, 9, 15])
    blocks = [f"<p>{draw.choice(main)}</p>" for _ in range(count)]
    for _ in range(draw.randint(0, 2)):
        blocks.insert(draw.randrange(len(blocks) + 1), draw.choice([
            f"<h2>{words(2, 6)}</h2>", f"<blockquote><p>{draw.choice(main)}</p></blockquote>", f"<ul><li>{draw.choice(main)}</li><li>{words(3, 12)}</li></ul>",
            f"<p>{words(1, 4)} <a href='/y'>{words(1, 3)}</a> {draw.choice(main)}</p>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<p><b>{draw.choice(main)}<br><p>{draw.choice(main)}</p>"]))
    head = f"<h1>{words(3, 9)}</h1>" if draw.random() < 0.8 else ""
    if head and draw.random() < 0.2:
        head = f"<header>{head}</header>"
    inner = [named(AREAS["inner"], words(3, 15), 0) if draw.random() < 0.15 else "" for _ in range(2)]
    text = named(MAIN, head + "".join(blocks[: count // 2]) + inner[0] + "".join(blocks[count // 2 :]) + inner[1], 1)
    said = "".join(f'<div class="comment"><p>{draw.choice(main)}</p></div>' if draw.random() < 0.7 else f"<p>{draw.choice(main)}</p>" for _ in range(draw.randint(1, 5)))
    ahead = [
        named(AREAS["menu"], links(), 0),
        named(AREAS["header"], f"<h2>{words(1, 4)}</h2><p>{words(2, 8)}</p>", 0),
        named(AREAS["notice"], lines(other, 1, 1), 0),
        named(AREAS["advert"], lines(other, 1, 2) if draw.random() < 0.5 else draw.choice(other), 0),
        named(AREAS["trail"], f"<a href='/z'>{words(1, 2)}</a> &gt; {words(1, 3)}", 0)]
    after = [
        named(AREAS["side"], f"<h3>{words(1, 3)}</h3>" + (links() if draw.random() < 0.6 else lines(other, 1, 3)), 0),
        named(AREAS["form"], f"<p>{words(2, 8)}</p><label>{words(1, 3)}</label><input name='q'>", 0),
        named(AREAS["comments"], said, 0),
        named(AREAS["footer"], f"&copy; {words(3, 12)}" + (links() if draw.random() < 0.3 else ""), 0)]
    page = "".join(x for x in ahead if draw.random() < 0.5) + text + "".join(x for x in after if draw.random() < 0.5)
    if draw.random() < 0.5:
        page = f'<div class="{draw.choice(["wrapper", "container", "page", "site"])}">{page}</div>'
    return f"<html><body>{page}</body></html>"


@dataclass
class Blocks:
    """What attribute tokens stand for, and the trees over the features of a node."""

    known: np.ndarray
    trees: Trees

    def odds(self, pages: list[Page]) -> list[np.ndarray]:
        """Log-odds of main text per node of each page."""
        rows = [features(page, self.known) for page in pages]
        return np.split(self.trees.score(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []


def labelled(html: str) -> Page:
    """A rendered page; nodes inherit the label of the area around them."""
    page = parse(html)
    for i in range(1, len(page.label)):
        page.label[i] = page.label[i] or page.label[page.parent[i]]
    return page


def train(pages: list[str], count: int = RENDERED, seed: int = SEED) -> Blocks:
    """The model fitted on pages rendered from the texts of the given ones."""
    texts = [text for html in pages for _, text in parse(html).texts]
    long = [x for x in texts if len(x) >= 40] or ["A plain sentence, of some length, that stands for the text of a page."]
    short = [x for x in texts if len(x) < 160] or ["A short line of text."]
    draw = random.Random(seed)
    made = [labelled(rendered([x[:2000] for x in draw.choices([*long, *short], k=12)], draw.choices(short, k=12), draw)) for _ in range(count)]
    known = evidence(made[: count // 2])
    rows, labels = [], []
    for page in made[count // 2 :]:
        used = [i for i, y in enumerate(page.label) if y]
        rows.append(features(page, known)[used])
        labels.append(np.array([page.label[i] == "1" for i in used], dtype=float))
    return Blocks(known, boost(np.concatenate(rows), np.concatenate(labels)))


def model(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id", html: str = "html") -> Blocks:
    """The model, trained with texts from a bounded sample of the pages."""
    some = sampled(pages.where(F.length(html) <= LONGEST).select(key, html), sample, key, html).select(html).collect()
    return train([row[0] for row in some])


def extracted(pages: DataFrame, blocks: Blocks, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            # A few pages at a time: the trees like long columns, memory does not.
            for first in range(0, batch.num_rows, 64):
                parsed = [parse(x.as_py()) for x in batch.column(2).slice(first, 64)]
                texts += [decode(page, own) for page, own in zip(parsed, blocks.odds(parsed), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    schema = f"key {rows.schema[0].dataType.simpleString()}, url {rows.schema[1].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
