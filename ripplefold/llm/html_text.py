"""Operator 4, main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: stop-word density, length and link density call
a block text, boilerplate, or leave it open; a container made for articles lowers the density that is asked
for, one that can't hold an article makes its blocks boilerplate, and so do short calls to subscribe, share
and the like. Second pass: an open block takes the label of the nearest decided block, first among those
of the same kind of container; at equal distance text wins inside an article and boilerplate outside of one.

Contract: null or empty html gives an empty text. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by one newline in page order; nothing else is
dropped or cut. Markup that never closes ends with the page. Repeated rows give repeated results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role, and class or id words of containers that hold no article.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "title", "select", "button", "object", "math"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
JUNK_NAMES = re.compile(r"(?<!\bno)(?<!\bhas)(?<!\bwith)(?<!\bwithout)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|sidebar|side|menu|nav\w*|breadcrumbs?|header|footer|comments?|comment-?list|disqus|repl(?:y|ies)|share|sharing|social|related|recommended|newsletter|subscribe|widget|login|search)(?:$|[\s_-])", re.I)
# Frequent words of four languages.
STOP = frozenset("the of and to in is that for it with as was on be at by this are from or an which you not have der die und das von mit den ist im nicht ein eine des zu auf sich dem als auch für es an la le les et un une que qui dans pour du au pas sur plus ce il elle el los las del y se con por su para lo no a de en des est avec ou par".split())
# A quoted value that holds the start of another tag, or never ends, was left open: the tag then ends at its first >.
PIECES = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"(?:[^\"<]|<(?![a-zA-Z/!]))*\"|'(?:[^'<]|<(?![a-zA-Z/!]))*'|[^>])*)>?|([^<]+|<)", re.S)
# What short blocks say that are no part of a text.
CALLS = re.compile(r"(?:advert\w*|sponsored(?: (?:content|post|link))?|promoted|subscribe(?: now| to .{1,40})?|sign up.{0,40}|log ?in|share(?: (?:this|on) .{1,30})?|follow us.{0,30}|read more|continue reading|related (?:articles|posts|stories)|buy now.{0,30}|shop now|learn more|accept(?: all)? cookies|skip to content|back to top|print this page)[.!:…»>]*", re.I)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACES = re.compile(r"\s+")
STRIP = "\"'.,;:!?()[]#*$%&|<>"

TEXT, OPEN, BOILERPLATE = 1, 0, -1


def blocks_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, inside an outside-container, inside an article container) block by block."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool]] = []
    links, outside, article = 0, 0, 0
    skip_to, at, end = None, 0, len(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, outside > 0, article > 0))
        parts, linked = [], 0

    while at < end:
        m = PIECES.match(page, at)
        at = m.end()
        closing, name, attributes, data = m.groups()
        if data is not None:
            parts.append(data)
            if links:
                linked += len(data.strip())
            continue
        if name is None:
            continue
        name = name.lower()
        if not closing and name in RAW:
            close() if name not in INLINE else None
            if not attributes.rstrip().endswith("/"):
                found = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
                at = page.find(">", found.start()) + 1 if found else end
                at = at or end
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for _, was_out, was_art in stack[i:]:
                        outside -= was_out
                        article -= was_art
                    del stack[i:]
                    links = 0
                    break
        elif name not in VOID and not attributes.endswith("/"):
            named = " ".join(x for y in NAMES.findall(attributes) for x in y if x)
            is_out = name in OUTSIDE and not (name == "header" and article) or (name not in ("html", "body", "article", "main") and bool(named) and bool(JUNK_NAMES.search(named)))
            if name == "p":
                while stack and stack[-1][0] == "p":
                    _, was_out, was_art = stack.pop()
                    outside -= was_out
                    article -= was_art
            is_art = name in ARTICLE
            stack.append((name, is_out, is_art))
            outside += is_out
            article += is_art
    close()
    return out


def labels_of(blocks: list[tuple[str, int, bool, bool]], high: float = 0.15, low: float = 0.05, short: int = 70, most_links: float = 0.5) -> list[int]:
    """TEXT or BOILERPLATE for each block."""
    first = []
    for text, linked, outside, article in blocks:
        words = text.split()
        stops = sum(w.strip(STRIP).lower() in STOP for w in words) / len(words)
        if outside or linked > most_links * len(text) or len(text) < short and CALLS.fullmatch(text):
            first.append(BOILERPLATE)
        elif len(text) < short:
            first.append(OPEN)
        elif stops >= (low if article else high):
            first.append(TEXT)
        else:
            first.append(OPEN if article or stops >= low else BOILERPLATE)
    kinds = [(outside, article) for _, _, outside, article in blocks]
    near = {kind: _nearest(first, [k == kind for k in kinds]) for kind in set(kinds)}
    anywhere = _nearest(first, [True] * len(first))
    out = []
    for i, ((_, _, _, article), label) in enumerate(zip(blocks, first)):
        if label == OPEN:
            (before, b), (after, a) = near[kinds[i]][i]
            if not b and not a:
                (before, b), (after, a) = ((0, TEXT), (0, TEXT)) if article else anywhere[i]
            if not b or not a:
                label = b or a or (TEXT if article else BOILERPLATE)
            else:
                label = b if before < after or b == a else a if after < before else TEXT if article else BOILERPLATE
        out.append(label)
    return out


def _nearest(labels: list[int], count: list[bool]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """For each block, how far off the decided blocks that count are before and behind it, and their labels (OPEN: none)."""
    def one_way(order):
        found, at, seen = {}, 0, OPEN
        for i in order:
            found[i] = (abs(i - at), seen)
            if count[i] and labels[i]:
                at, seen = i, labels[i]
        return found

    ahead, back = one_way(range(len(labels))), one_way(range(len(labels) - 1, -1, -1))
    return [(ahead[i], back[i]) for i in range(len(labels))]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(text for (text, *_), label in zip(blocks, labels_of(blocks)) if label == TEXT)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
