"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of block-level tags (with classes) from the root to it.
Per path, text length and punctuation are summed over its blocks and divided by the number of blocks; text in links
counts against it. The two ratios are smoothed with those of the paths under the same parent, fused by their product,
and paths whose fused ratio reaches a part of the page's highest are content; so a short paragraph stays if its path's
other paragraphs are content. What the page itself marks as an article weighs more in the fused ratio, what it marks as
navigation, advertising, comments and the like is never content.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A path is content if its fused ratio is at least this part of the highest.
THRESHOLD = 0.08
#: Weight of the neighbours in smoothing.
SMOOTH = 0.5
#: Weight of a marked article in the fused ratio.
ARTICLE = 3.0

# Fixed lists: HTML elements and the words by which pages name their parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
_DROP = frozenset("head nav footer aside form button select menu dialog audio video datalist dir".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption body html option optgroup button".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
_STOPS = frozenset("ul ol dl table article section div body html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar sidebars related recommended recommendations comment comments disqus respond replies footer nav navbar navigation menu menus breadcrumb breadcrumbs share sharing social toolbar login signin signup search pagination pager masthead topbar skip tracking paywall alert form".split()
)
_HEADER_NAMES = frozenset("header masthead".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_ARTICLE_NAMES = frozenset("articlebody".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_NAME = re.compile(r"[a-zA-Z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile("[.,;:!?…。，；：！？、¿¡]")


class Block(NamedTuple):
    path: tuple[str, ...]
    article: bool
    text: str
    linked: int


def _names(value: str) -> set[str]:
    return {x.lower() for x in _NAME.findall(_CAMEL.sub(" ", value))}


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in order, without what it marks as no content."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # label, dropped, article
    tags: list[str] = []
    text: list[str] = []
    links = linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(Block(tuple(x[0] for x in stack), bool(stack) and stack[-1][2], joined, linked))
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        del stack[to:], tags[to:]

    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            piece = html[at:stop]
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name not in _BLOCK and name not in _RAW:
            if name == "br":
                flush()
            elif name == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            if name in tags:
                pop(len(tags) - 1 - tags[::-1].index(name))
            elif name == "p":
                continue
            continue
        if name in _VOID:
            continue
        rest = m[3] if m[2] else m[6] or ""
        if name in _RAW:
            if not rest.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
            continue
        links = 0 if name in ("article", "main", "nav", "footer") else links
        if name in _CLOSES_P and "p" in tags:
            k = len(tags) - 1 - tags[::-1].index("p")
            if not any(x in _STOPS for x in tags[k + 1 :]):
                pop(k)
        if name in _SAME:
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] in _SAME[name].split():
                    pop(k)
                    if name != "tr" or tags[k - 1 : k] != ["tr"]:
                        break
                elif tags[k] in _STOPS or tags[k] in ("tbody", "thead", "tfoot"):
                    break
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        label = name
        if rest.strip(" \t\r\n/"):
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
            given = f"{found.get('class', '')} {found.get('id', '')}"
            names = _names(given)
            role = found.get("role", "").lower()
            if name not in ("html", "body", "article", "main"):
                dropped = dropped or bool(names & _NAMES) or role in _ROLES or (bool(names & _HEADER_NAMES) and not article and name not in _HEADINGS)
                dropped = dropped or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            article = article or role in ("main", "article") or found.get("itemprop", "").lower() in _ARTICLE_NAMES
            if found.get("class"):
                label = f"{name}.{' '.join(found['class'].split())}"
        dropped = dropped or name in _DROP or (name == "header" and not article)
        article = article or name in ("article", "main")
        stack.append((label, dropped, article))
        tags.append(name)
    flush()
    return out


def selected(found: list[Block]) -> list[Block]:
    """The content among a page's blocks."""
    # A path inside a marked article counts as another than the same path outside.
    chars: dict[tuple, int] = defaultdict(int)
    points: dict[tuple, int] = defaultdict(int)
    linked: dict[tuple, int] = defaultdict(int)
    nodes: dict[tuple, int] = defaultdict(int)
    for b in found:
        p = (b.path, b.article)
        chars[p] += len(b.text)
        points[p] += len(_PUNCTUATION.findall(b.text))
        linked[p] += b.linked
        nodes[p] += 1
    # Ratios, smoothed within the parent, fused.
    plain = {p: max(0, chars[p] - linked[p]) / nodes[p] for p in chars}
    dots = {p: (points[p] + 0.1) / nodes[p] for p in chars}
    around: dict[tuple, list[tuple]] = defaultdict(list)
    parent = lambda p: (p[0][:-1], p[1])
    for p in chars:
        around[parent(p)].append(p)

    def smooth(ratio: dict[tuple, float]) -> dict[tuple, float]:
        return {p: (1 - SMOOTH) * ratio[p] + SMOOTH * sum(ratio[q] for q in around[parent(p)]) / len(around[parent(p)]) for p in ratio}

    smooth_chars, smooth_dots = smooth(plain), smooth(dots)
    fused = {p: smooth_chars[p] * smooth_dots[p] * (1 - min(1, linked[p] / max(1, chars[p]))) * (ARTICLE if p[1] else 1) for p in chars}
    most = max(fused.values(), default=0)
    return [b for b in found if fused[b.path, b.article] >= THRESHOLD * most and fused[b.path, b.article] > 0]


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by line feeds; empty if there are none."""
    return "\n".join(b.text for b in selected(blocks(html or "")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each row with text and n_chars (its code points); columns of these names are replaced.

    Null and empty html give an empty text; so does a page without content. Each whole page is read, whatever its length.
    """
    pages = pages.drop("text", "n_chars")
    schema = pages.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
