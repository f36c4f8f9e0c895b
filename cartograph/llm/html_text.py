"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped to lines, one a block of the page.  Every line has a weight:
the length of its text outside links, the less the more of it is linked, and a
little for being a line.  Markup makes that heavier or lighter by a factor:
lines in a marked article (one with at least half of the page's text outside
links) gain half, those outside of it and those of menus, headers, footers,
adverts, forms or comments keep a small part, however long they are.  The
distribution is the sums of weights over sliding windows.  Where a window surges
a stretch of content begins, where it falls to what a light line weighs it ends;
the lines between surge and dive that are no light ones themselves are the text.
A short line of an article is thus kept for what stands after it, and a lone
stray line is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: A window's sum of weights from which a stretch begins.
SURGE = 80
#: A window's sum of weights below which it ends, and the weight below which a line is a light one.
LIGHT = 15
#: What a line has for being one, if most of it is outside links.
PLAIN = 20
#: Factors of markup: of parts that are no content, of lines outside of a marked article, and of lines in it.
BARRED, OUTSIDE, INSIDE = 0.02, 0.04, 1.5

# Elements by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("nav header footer aside form menu dialog head title button select option textarea noscript template iframe object canvas svg math audio video map datalist".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
EMPTY = frozenset("svg math iframe object".split())  # those that a slash closes at once
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNLIKELY = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation navi breadcrumb breadcrumbs sidebar sidenav side widget footer foot header masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social follow related recommended recommendations pagination pager tags tagcloud meta byline search skip copyright legal disclaimer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_part = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_attribute = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_space = re.compile(r"\s+")


def _unlikely(attributes: str) -> bool:
    """Whether class, id or role name a part that is no content, or hide it."""
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and not UNLIKELY.isdisjoint(re.split(r"[\s_\-:]+", value)):
            return True
        if name == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, int, bool, bool]]:
    """The page's blocks in order: text, its length outside links, whether in a part that is no content, whether in an article."""
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    linked = 0  # characters of this line inside links
    stack: list[tuple[str, bool, bool]] = []  # open elements that matter: name, no content, article
    opened: dict[str, int] = {}  # how many of a name are open
    links = 0

    def end_line() -> None:
        nonlocal linked
        line = _space.sub(" ", unescape("".join(text))).strip()
        if line:
            out.append((line, max(0, len(line) - linked), bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))
        text.clear()
        linked = 0

    def close(name: str) -> None:
        if opened.get(name):
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break

    at = 0
    while True:
        m = _part.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(unescape(piece).strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:-3])
            continue
        closing, attributes = bool(m[1]), m[3] if m[3] is not None else m[4] or ""
        if name in EMPTY and attributes.endswith("/"):
            continue
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not end and name in EMPTY:
                continue  # a drawing or frame that nothing ends has no text of its own
            at = end.end() if end else len(html)
            if name == "title":
                end_line()
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
            continue
        if name in BLOCKS or name in NEVER:
            end_line()
        if closing:
            close(name)
            continue
        if name in VOID:
            continue
        bad = bool(attributes) and _unlikely(attributes)
        if name in BLOCKS or name in NEVER or bad:
            if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next begins
                close("p")
            if name not in ("html", "body"):
                _, barred, article = stack[-1] if stack else ("", False, False)
                stack.append((name, barred or name in NEVER or bad, article or name in ("article", "main")))
                opened[name] = opened.get(name, 0) + 1
    end_line()
    return out


def weights(lines: list[tuple[str, int, bool, bool]]) -> np.ndarray:
    """What every line weighs."""
    free = lambda wanted: sum(n for _, n, barred, article in lines if not barred and wanted(article))
    marked = any(article and not barred for _, _, barred, article in lines) and 2 * free(bool) >= free(lambda _: True)
    factor = lambda barred, article: BARRED if barred else 1.0 if not marked else INSIDE if article else OUTSIDE
    return np.array([(n * n / len(line) + PLAIN * (2 * n >= len(line))) * factor(barred, article) for line, n, barred, article in lines], np.float64)


def between(weights: np.ndarray, window: int = WINDOW, surge: float = SURGE, light: float = LIGHT) -> np.ndarray:
    """Which lines are the text, by what the lines weigh alone."""
    if not len(weights):
        return np.zeros(0, bool)
    sums = np.convolve(weights, np.ones(window))[window - 1 :]  # of a line and those after it
    surge = min(surge, sums.max())  # on a short page its heaviest stretch
    inside, out = False, np.zeros(len(weights), bool)
    for k, s in enumerate(sums.tolist()):
        inside = s >= surge or inside and s >= light
        out[k] = inside
    return out & (weights >= min(light, weights.max()))


def main_lines(lines: list[tuple[str, int, bool, bool]], window: int = WINDOW) -> list[str]:
    """The lines between surge and dive."""
    return [line for (line, *_), keep in zip(lines, between(weights(lines), window)) if keep]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_lines(lines_of(html or "")))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null html is empty and has empty text; repeated rows are extracted each;
    other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
