"""Main text of web pages.

The recorder that this library follows keeps no pages, so the operator is general: it works on any table
with an id column and a column of HTML.

Method: maximum-scoring subsequence.  A page is read as a sequence of words and tags; each has a weight,
positive where it tells for the article and negative where it tells for the frame around it, and a linear
scan finds the contiguous stretch of highest sum.  Weights are log ratios counted on labelled pages: pages
that mark their article with <article> or <main> label themselves, and no weight is counted on the mark
itself.  The mark is one more weight, as large as the share of the page's text that it covers tells.
Elements that never belong to the article (menus, forms, scripts, ...) cost much and are left out of the
stretch.  So are those whose class, id or role names a frame (adverts, notices, comments, ...), unless the
text inside outweighs the name; an <article> or <main> below ends what a wrapper's name says.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import bounded_sample

MAX_PAGES = 5_000  # pages among which labelled ones are looked for
MAX_KINDS = 2_000  # kinds of element with a weight of their own
BOILERPLATE = -3.0  # weight of a block that never belongs to the article
LIMIT = 4.0  # largest weight
MARK = 3.0  # weight of a mark that covers all of a page's text, below that of a word
NAMED = 0.1  # what a stretch counts that takes in elements named as frames, and a word of little weight under a mark

RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("head nav aside form button select svg math canvas object video audio menu dialog fieldset map".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one like them begins.
SIBLINGS = frozenset("p li dt dd td th tr option".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())  # fmt: skip
ARTICLE = frozenset(("article", "main"))
#: Names in class, id and role that tell what an element is.
FRAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|adbox|adunit|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|"
    r"popups?|modal|overlay|newsletter|subscri\w*|signup|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|aside|footer|header|"
    r"masthead|topbar|toolbar|comments?|commentlist|disqus|respond|replies|related|recommend\w*|share|sharing|social|widgets?|"
    r"pagination|pager|skip|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
#: Names that an <article> below does not lift: it is a comment or a teaser.
OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies|related|recommend\w*)(?:$|[\s_-])", re.I)
#: Layout names that only tell of a frame elsewhere on the page.
LAYOUT = re.compile(r"\b(?:with|without|has|no)[-_][\w-]*", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")


class Block(NamedTuple):
    """A stretch of text without a block border inside; ``kind`` is what its weight depends on."""

    text: str
    kind: str
    words: int
    skipped: bool
    marked: bool  # inside <article> or <main>
    tags: tuple[str, ...]  # tags between the block before and this one
    named: bool = False  # inside an element whose name tells of a frame


NOTHING, NAME, FIXED_NAME, FRAME_ELEMENT = range(4)


def _frame(name: str, attributes: str, in_article: bool) -> int:
    """What an element tells by itself: nothing, a frame by name (one that nothing below lifts), or a frame in any case."""
    if name in SKIPPED:
        return FRAME_ELEMENT
    if name in ("header", "footer"):
        return FRAME_ELEMENT if name == "footer" or not in_article else NOTHING
    if not attributes or name in ("html", "body"):
        return NOTHING
    found = NOTHING
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role"):
            value = LAYOUT.sub("", value.strip("\"'"))
            names = {m[0].strip().lower().strip("-_") for m in FRAME.finditer(value)}
            if names - ({"header"} if in_article else set()):
                found = max(found, FIXED_NAME if OTHERS.search(value) else NAME)
        if key in ("hidden", "aria-hidden") and value.strip("\"'").lower() in ("", "true", "hidden"):
            return FRAME_ELEMENT
        if key == "style" and HIDDEN.search(value):
            return FRAME_ELEMENT
    return found


def blocks(page: str) -> list[Block]:
    """The page's text in blocks, markup and character references resolved."""
    out: list[Block] = []
    text: list[str] = []
    tags: list[str] = []
    open_: list[str] = []  # elements that are open, outermost first
    frame: list[int] = []  # of each open element, what it and those around it tell
    state = [0, 0]  # open <article> or <main>; open <a>
    linked = [0, 0]  # characters of the current block, and those of them in links

    def border() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            holder = next((t for t in reversed(open_) if t not in INLINE and t not in ARTICLE), "body")
            link = "link" if 2 * linked[1] > linked[0] else "text"
            level = frame[-1] if frame else NOTHING
            out.append(Block(joined, f"{holder} {link}", len(joined.split(" ")), level == FRAME_ELEMENT, state[0] > 0, tuple(tags),
                             level in (NAME, FIXED_NAME)))
            tags.clear()
        text.clear()
        linked[:] = [0, 0]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith(("<!", "<?")):
                continue
            piece = html.unescape(m[0])
            text.append(piece)
            linked[0] += len(piece)
            linked[1] += len(piece) * (state[1] > 0)
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if not closing and name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name not in INLINE:
            border()
            if name not in ARTICLE:
                tags.append(("/" if closing else "") + name)
        if name in VOID or attributes.endswith("/") and not closing and name not in INLINE | ARTICLE and name in ("path", "rect", "circle", "use"):
            continue
        if closing:
            if name in open_:
                while open_:
                    last = open_.pop()
                    frame.pop()
                    state[0] -= last in ARTICLE
                    state[1] -= last == "a"
                    if last == name:
                        break
            continue
        if name in SIBLINGS and open_ and open_[-1] == name:
            open_.pop()
            frame.pop()
        open_.append(name)
        state[0] += name in ARTICLE
        state[1] += name == "a"
        around, own = frame[-1] if frame else NOTHING, _frame(name, attributes, state[0] > 0)
        if name in ARTICLE and around == NAME:
            around = NOTHING
        if own > around and name in INLINE:
            border()
        frame.append(max(around, own))
    border()
    return out


class Weights(NamedTuple):
    """Log ratios: of words by the kind of their block, and of tags; ``marked`` where a mark covers all of the text."""

    words: dict[str, float]
    tags: dict[str, float]
    word: float = 1.0
    tag: float = -0.5
    marked: float = MARK


def count_kinds(found: list[Block]) -> Iterator[tuple[str, int, int]]:
    """(name, weight inside the article, outside) of a page that marks its article; no rows of other pages."""
    if not any(b.marked and not b.skipped and not b.named for b in found):
        return
    for b in found:
        inside = b.marked and not b.skipped and not b.named
        if not b.skipped and not b.named:
            yield f"w {b.kind}", b.words * inside, b.words * (not inside)
        for tag in b.tags:
            yield f"t {tag}", int(inside), int(not inside)


def learn_weights(pages: DataFrame, html_column: str = "html", max_pages: int = MAX_PAGES,
                  max_kinds: int = MAX_KINDS) -> Weights:
    """Weights from those pages of a sample of at most about ``max_pages`` that mark their article.

    The ``max_kinds`` kinds of element that most words and tags belong to get a weight, equal ones by name; the others
    weigh what an unknown kind does.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for page in batch.column(0).to_pylist() for r in count_kinds(blocks(page or ""))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["name", "inside", "outside"])

    drawn = bounded_sample(pages.select(html_column), F.xxhash64(html_column), max_pages)
    counts = drawn.mapInArrow(scan, "name string, inside long, outside long").groupBy("name").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(max_kinds).collect()
    ratio = {r["name"]: float(np.clip(np.log((r["inside"] + 1) / (r["outside"] + 1)), -LIMIT, LIMIT)) for r in rows}
    words = {n[2:]: v for n, v in ratio.items() if n.startswith("w ")}
    return Weights(words, {n[2:]: min(0.0, v) for n, v in ratio.items() if n.startswith("t ")})


def _best_stretch(found: list[Block], weights: Weights, named: bool) -> tuple[float, str]:
    """Score and text of the best stretch; blocks named as frames are left out unless ``named``."""
    left_out = [b.skipped or b.named and not named for b in found]
    scores = [b.words * weights.words.get(b.kind, weights.word if b.kind.endswith("text") else -weights.word) for b in found]
    told = [(score if score > 0 else NAMED * b.words, b.marked) for b, score, out in zip(found, scores, left_out, strict=True) if not out]
    total, covered = sum(v for v, _ in told), sum(v for v, marked in told if marked)
    # a mark on less than half of the text, like one on teasers, tells nothing
    mark = weights.marked * max(0.0, 2 * covered / total - 1) if total else 0.0
    best, best_span, run, begin = 0.0, (0, 0), 0.0, 0
    for i, (b, score, out) in enumerate(zip(found, scores, left_out, strict=True)):
        before = sum(weights.tags.get(t, weights.tag) for t in b.tags)
        if out:
            # left out in any case; a stretch goes on behind it if more of the article follows
            value = 0.0 if b.marked else BOILERPLATE
        else:
            value = score + b.words * (mark if b.marked else -mark)
        if run + before <= 0:  # a new stretch does better, and the tags before it are not its own
            run, begin, before = 0.0, i, 0.0
        run += before + value
        if run > best:
            best, best_span = run, (begin, i + 1)
    return best, " ".join(b.text for b, out in zip(found[slice(*best_span)], left_out[slice(*best_span)], strict=True) if not out)


def main_text(page: str, weights: Weights) -> str:
    """Text of the best stretch of blocks, without those that never belong to an article."""
    found = blocks(page)
    best, text = _best_stretch(found, weights, False)
    if any(b.named and not b.skipped for b in found):
        every, with_named = _best_stretch(found, weights, True)
        if NAMED * every > best:
            return with_named
    return text


def page_texts(pages: DataFrame, weights: Weights | None = None, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each page (empty if there is none), in place of the html.

    Weights are learned from ``pages`` if not given, for at most ``MAX_KINDS`` kinds of element.  White space inside a block becomes one space; blocks
    follow in page order with one space between.  Null and empty pages, and pages without words, have an
    empty text; unclosed elements end with their parents.  Rows are kept one by one, repeated or not.  A
    column ``text`` is replaced.
    """
    if weights is None:
        weights = learn_weights(pages, html_column)
    rows = pages.drop(*{"text"} - {html_column})
    rest = [c for c in rows.columns if c != html_column]
    schema = rows.select(*rest, F.lit("").alias("text")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column(html_column)[i].as_py() or "", weights) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string())], names=[*rest, "text"])

    return rows.mapInArrow(scan, schema)
