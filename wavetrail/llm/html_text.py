"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat text blocks. Each block has its number of words and
its link density, those of its two neighbours, and what encloses it (an article, a page part such
as navigation, a heading). A decision tree trained on the small labelled table below says which
blocks are main text; their texts are joined in page order by one space.

Null or empty html gives an empty text. Markup that is not closed ends with the page; character
references are decoded; white space inside a block becomes one space. Nothing is cut off.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of HTML elements, by what they do to the flow of text.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
PARTS = frozenset("nav header footer aside form menu dialog fieldset select".split())
OUTER = frozenset("html body main article".split())
NESTING = frozenset("article aside details dialog div dl fieldset figure footer form header li main menu nav ol section select table td tr ul head".split())
HIDDEN = ("script", "style", "noscript", "template", "textarea")
CLOSABLE = ("svg", "iframe", "object", "canvas", "button")  # hidden too; "/>" ends them
# Words of class, id and role that name page parts and the article.
PART_WORDS = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split())
MAIN_WORDS = frozenset("article content entry main post story".split())

_RAW = "|".join(HIDDEN)
#: What ends a head: its end tag (taken too), the body, or the first tag of the flow where end tags are left out.
_HEAD_END = r"</head\b|<body\b|<(?:" + "|".join(sorted(BLOCK_TAGS - {"head", "html", "title", "body"})) + r"|a|span|img|b|i|em|strong)\b"
_SKIP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + _RAW + r")\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(" + "|".join(CLOSABLE) + r")\b[^>]*+(?:(?<=/)>|>.*?(?:</\2\s*>|\Z)|\Z)"
    r"|<head\b[^>]*+(?:(?<=/)>|>(?:[^<]++|<!--.*?(?:-->|\Z)|<(" + _RAW + r"|title)\b.*?(?:</\3\s*>|\Z)|(?!" + _HEAD_END + r")<)*+(?:</head\s*>)?|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_WORD = re.compile(r"[a-z]+")
_GONE = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Block:
    text: str
    words: int
    links: float
    part: int  # inside a page part
    article: int  # 2 inside an article, 1 outside while the page has one, 0 without one on the page
    heading: int


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order."""
    page = _SKIP.sub(" ", page)
    stack: list[tuple[str, int, int]] = []  # tag, is a part, is an article
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = in_part = in_article = hidden = 0
    found_article = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                m = len(" ".join(html.unescape(" ".join(linked)).split()).split(" ")) if linked else 0
                out.append(Block(text, n, min(1.0, m / n), int(in_part > 0 or hidden > 0), 2 if in_article else 0, heading))
            parts, linked = [], []

    def pop() -> None:
        nonlocal in_part, in_article
        _, was_part, was_article = stack.pop()
        in_part, in_article = in_part - was_part, in_article - was_article

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        ends = m.group(1) == "/"
        if name == "a":
            in_link = 0 if ends else 1
            continue
        if name not in BLOCK_TAGS:
            continue
        close()
        hidden = int(not ends and bool(_GONE.search(m.group(3))))  # of a tag that holds no other block
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            heading = 0 if ends else 1
        if name not in NESTING:
            continue
        gone, hidden = hidden, 0
        if ends:
            if any(tag == name for tag, _, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        attributes = m.group(3)
        names = {w for found in _NAMES.findall(attributes) for w in _WORD.findall("".join(found).lower())}
        is_article = int(name in ("article", "main") or bool(names & MAIN_WORDS) and not names & PART_WORDS)
        is_part = int(name in PARTS or name not in OUTER and bool(names & PART_WORDS))
        if name == "header" and in_article and not names & PART_WORDS:
            is_part = 0  # the head of an article belongs to it
        is_part = is_part or gone
        if attributes.endswith("/"):
            continue
        found_article |= bool(is_article)
        stack.append((name, is_part, is_article))
        in_part, in_article = in_part + is_part, in_article + is_article
    tail = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", tail)  # a tag that the end of the page cuts off
    parts.append(tail[: cut.start()] if cut else tail)
    close()
    if found_article:
        for b in out:
            b.article = b.article or 1
    return out


FEATURES = ("part", "article", "words", "links", "before_words", "before_links", "after_words", "after_links", "heading")

# The labelled table: inside a page part, article (see Block), words, link density, the same two of
# the block before and of the block after (-1: none), heading, label (1: main text).
LABELLED = """
1 0 6 1.0 -1 -1 6 1.0 0 0
1 0 1 1.0 1 1.0 1 1.0 0 0
1 1 1 1.0 -1 -1 1 1.0 0 0
0 0 3 1.0 2 1.0 4 1.0 0 0
0 1 2 1.0 3 1.0 2 1.0 0 0
0 0 5 0.8 4 1.0 60 0.0 0 0
1 1 8 0.0 1 1.0 9 0.0 0 0
1 1 12 0.0 2 1.0 40 0.0 0 0
1 1 9 0.0 80 0.0 -1 -1 0 0
1 0 14 0.1 45 0.0 -1 -1 0 0
1 1 60 0.0 70 0.0 20 0.0 0 0
1 2 90 0.0 60 0.0 50 0.0 0 0
1 2 7 0.0 30 0.0 12 0.0 0 0
1 2 25 0.3 60 0.0 8 0.5 0 0
0 1 4 0.0 90 0.0 5 0.2 0 0
0 1 11 0.2 6 1.0 3 1.0 0 0
0 1 40 0.0 9 0.0 30 0.0 0 0
0 0 5 0.0 3 1.0 2 1.0 0 0
0 0 6 0.5 7 0.6 5 1.0 0 0
0 0 3 0.0 2 1.0 1 1.0 0 0
0 0 18 0.9 12 0.9 15 0.9 0 0
0 0 35 0.7 20 0.8 25 0.6 0 0
0 0 2 0.0 -1 -1 2 0.5 0 0
0 2 9 0.0 70 0.0 7 0.0 1 1
0 2 8 0.0 5 0.0 120 0.0 1 1
0 2 120 0.0 8 0.0 90 0.02 0 1
0 2 3 0.0 60 0.0 80 0.0 0 1
0 2 1 0.0 40 0.0 2 0.0 0 1
0 2 2 0.0 1 0.0 9 0.0 0 1
0 2 1 1.0 30 0.0 25 0.0 0 1
0 2 12 1.0 50 0.0 45 0.0 0 1
0 2 20 0.6 80 0.0 60 0.1 0 1
0 2 45 0.3 20 0.0 1 0.0 0 1
0 2 70 0.0 1 1.0 3 0.0 0 1
0 2 200 0.05 150 0.0 -1 -1 0 1
0 2 6 0.0 8 0.0 7 0.0 0 1
0 0 80 0.0 12 0.0 60 0.0 0 1
0 0 60 0.1 75 0.0 50 0.0 0 1
0 0 30 0.05 45 0.0 60 0.0 0 1
0 0 22 0.0 -1 -1 70 0.0 0 1
0 0 150 0.2 6 1.0 90 0.0 0 1
0 0 16 0.0 40 0.0 35 0.0 0 1
0 0 7 0.0 4 1.0 80 0.0 1 1
0 0 5 0.0 60 0.0 70 0.0 1 1
0 0 4 0.0 50 0.0 65 0.0 0 1
0 2 1 0.0 1 1.0 1 1.0 0 1
0 2 2 0.0 -1 -1 6 1.0 0 1
0 2 4 0.5 3 1.0 2 1.0 0 1
0 2 9 0.0 8 0.0 6 1.0 1 1
0 2 60 0.0 6 1.0 6 1.0 0 1
0 2 5 1.0 4 1.0 3 1.0 0 1
0 2 30 0.2 1 1.0 -1 -1 0 1
0 2 400 0.0 8 0.0 9 0.5 0 1
0 2 3 0.0 9 0.0 15 0.1 1 1
0 2 11 0.0 90 0.0 6 0.0 0 1
0 2 70 0.0 20 1.0 12 0.2 0 1
0 2 6 0.0 2 0.0 1 1.0 0 1
0 2 16 0.3 14 0.9 15 0.9 0 1
0 2 1 0.0 200 0.0 9 0.0 0 1
0 2 8 0.0 6 1.0 8 0.0 1 1
1 0 30 0.0 60 0.0 70 0.0 0 0
1 1 70 0.0 90 0.0 30 0.0 0 0
1 2 200 0.0 150 0.0 60 0.0 0 0
1 2 40 0.0 30 0.0 -1 -1 0 0
1 2 9 0.0 20 0.0 12 0.0 1 0
1 1 150 0.1 8 0.0 10 0.0 0 0
1 0 5 0.0 60 0.0 40 0.0 1 0
1 2 3 1.0 20 0.0 2 1.0 0 0
1 0 55 0.0 7 1.0 60 0.0 0 0
1 1 9 0.0 80 0.0 10 0.0 1 0
1 2 22 0.0 45 0.1 33 0.0 0 0
1 0 100 0.0 90 0.0 -1 -1 0 0
0 1 25 0.0 60 0.0 70 0.0 0 0
0 1 60 0.0 8 0.0 9 0.0 0 0
0 1 90 0.1 6 1.0 4 1.0 0 0
0 1 8 0.0 100 0.0 -1 -1 1 0
0 1 12 0.0 4 1.0 120 0.0 0 0
0 1 5 0.4 30 0.0 5 1.0 0 0
0 1 33 0.0 -1 -1 20 0.0 0 0
0 1 7 0.0 50 0.0 30 0.0 0 0
0 1 120 0.0 100 0.0 80 0.0 0 0
0 0 150 0.0 90 0.0 -1 -1 0 1
0 0 80 0.0 60 0.0 9 0.0 0 1
0 0 45 0.0 3 1.0 5 0.5 0 1
0 0 200 0.1 4 1.0 2 1.0 0 1
0 0 60 0.0 -1 -1 -1 -1 0 1
0 0 70 0.05 90 0.0 3 1.0 0 1
0 0 110 0.0 6 1.0 7 0.4 0 1
0 0 35 0.0 50 0.0 12 0.0 0 1
0 0 17 0.0 -1 -1 -1 -1 0 1
0 0 14 0.5 60 0.0 8 0.3 0 0
0 0 9 0.3 -1 -1 4 1.0 0 0
0 0 8 0.6 3 1.0 5 0.0 0 0
"""


def labelled() -> list[tuple[tuple[float, ...], int]]:
    rows = [tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    return [(r[:-1], int(r[-1])) for r in rows]


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 6) -> tuple | int:
    """A tree of (feature, threshold, below, above) by Gini impurity; ties go to the first feature and threshold."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return 2 * len(part) * p * (1 - p)

    best = (impurity(rows), None)
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            t = (a + b) / 2
            low, high = [r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]
            cost = impurity(low) + impurity(high)
            if cost < best[0] - 1e-9:
                best = (cost, (f, t, low, high))
    if best[1] is None:
        return int(2 * ones >= len(rows))
    f, t, low, high = best[1]
    return f, t, grow(low, depth - 1), grow(high, depth - 1)


@lru_cache(1)
def tree() -> tuple | int:
    return grow(labelled())


def is_main(values: tuple[float, ...]) -> bool:
    node = tree()
    while not isinstance(node, int):
        node = node[2] if values[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(page: str | None) -> str:
    """Texts of the main blocks of a page, joined by one space."""
    found = blocks(page or "")
    sides = [(-1.0, -1.0), *((float(b.words), b.links) for b in found), (-1.0, -1.0)]
    kept = [b.text for i, b in enumerate(found) if is_main((b.part, b.article, b.words, b.links, *sides[i], *sides[i + 2], b.heading))]
    return " ".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch], html_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([main_text(p) for p in batch.column(html_at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[str(i) for i in range(batch.num_columns + 1)])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: `page_id`, `url`, `text`, `n_chars` (code points). One pass, no shuffle."""
    thin = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    out = thin.mapInArrow(lambda it: _extracted(it, 2), "page_id long, url string, html string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
