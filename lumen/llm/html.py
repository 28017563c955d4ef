"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one for each block of text. A line inside what
is no text of the article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, comments of readers) has length zero, as have lines
outside of the article where the page marks one, and lines of links. In an
article element, paragraphs, list items, cells and sentences count as
``SURGE`` characters at least, for there a short one is text as well; other
lines count as long as they are. Lengths are summed over windows of ``WINDOW`` lines: text is where
the sum surges, all lines between the surge and the dive are kept, but for
short lines at either end (menu entries, copyright) that are no sentence, and
headings stay with the text that follows them.

Blocks are what block elements delimit; a line break inside one is white
space. White space in a block becomes one space.

Defined cases: a null or empty page has no text; markup that is not closed
ends with the element around it or with the page; unknown tags count as
inline; pages of any length are read whole and in linear time; repeated rows
each get their result; other columns are kept and may have any name but
``out``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import small_batches

WINDOW = 3
# Characters of a window with text; on pages of less text half of its largest.
SURGE = 86
# Outside of a marked article, a line with a larger share of link text is none.
LINK_SHARE = 0.8

# Elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th option wbr img".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
NO_TEXT = frozenset("nav header footer aside form dialog menu button label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar sidebars side rail footer header masthead topbar comment comments "
    "commentlist respond reply replies disqus related recommended recommendations share sharing social widget widgets toolbar "
    "pagination pager skip".split())
# Names that begin so count as well.
STEMS = ("cookie", "advert", "sidebar", "newsletter", "breadcrumb", "sponsor")
# Words of class names that go with one of NAMES for the same thing (ad-slot).
PARTS = frozenset(
    "area bar block body bottom box button buttons card col column container content form group header icon icons inner "
    "item items label left link links list main message panel posts right row section slot text title top unit widget "
    "wrap wrapper".split())
# Names that begin so tell of the page's layout or subject, not of the element.
ABOUT = frozenset("category format has hide is no not show tag tagged topic with without".split())
ARTICLE = frozenset("article story post entry content main".split())
ARTICLE_PARTS = frozenset("area body container inner text wrap wrapper".split()) | ARTICLE
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Elements for text, other than paragraphs.
TEXTS = ("li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption")
# Elements that end an open one of the same kind without an end tag.
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Ends like a sentence, with quotes, brackets or other signs after it.
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f]\W*$")
_PIECE = re.compile(r"[a-z0-9]+")


def _named(token: str) -> bool:
    """A class or id that names what is no text of the article."""
    first, *rest = _PIECE.findall(token) or [""]
    if not rest:
        return first in NAMES or first.startswith(STEMS)
    if first in ABOUT or first in ARTICLE and rest[-1] == "header":
        return False
    if rest[-1] in NAMES and rest[-1] != "side" or rest[-1].startswith(STEMS):
        return True
    return (first in NAMES or first.startswith(STEMS)) and all(p in PARTS or p in NAMES or p.isdigit() for p in rest) \
        and not (first == "side" and rest[-1] == "side")


def _marking(token: str) -> bool:
    """A class or id that names the article."""
    pieces = _PIECE.findall(token)
    return not ARTICLE.isdisjoint(pieces) and ARTICLE_PARTS.issuperset(pieces[1:]) and not _named(token)


def _kind(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """(holds no text of the article, marks the article, has a name of what
    holds none)."""
    found = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    role = found.get("role", "")
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    none = (name in NO_TEXT and not (name == "header" and in_article) or role in ROLES or "hidden" in found
            or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""))
    element = name in ("article", "main") or role in ("main", "article")
    named = not none and not element and name not in ("html", "body") and any(map(_named, tokens))
    marks = not none and not named and (element or name in ("div", "section") and any(map(_marking, tokens)))
    return none, marks, named


def _overruled(lines: list[tuple[str, int, int, bool, int, int]], above: list[int]) -> set[int]:
    """The named elements that hold the article for all their names: without
    them no line is marked, and they have marked lines or most of the text.

    lines: the last entry is the innermost named element, 0 for none; above:
    the named element around each.
    """
    chars, mark = [0] * len(above), [0] * len(above)
    for line, links, rank, _, _, element in lines:
        chars[element] += len(line) - links if line else 0
        mark[element] = max(mark[element], rank)
    own = list(mark)
    for k in range(len(above) - 1, 0, -1):
        chars[above[k]] += chars[k]
        mark[above[k]] = max(mark[above[k]], mark[k])
    inside: dict[int, list[int]] = {}
    for k in range(1, len(above)):
        inside.setdefault(above[k], []).append(k)
    found, at = {0}, 0
    while not own[at] and at in inside:
        at, best = max(((k, (mark[k] > 0, chars[k])) for k in inside[at]), key=lambda x: x[1])
        if not best[0] and 2 * best[1] <= chars[0]:
            break
        found.add(at)
    return found


def lines_of(html: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, characters of links, rank of the article mark, is a heading, 2 in
    a paragraph and 1 in another of TEXTS) of each line; an element without text of the article leaves
    WINDOW empty lines."""
    lines: list[tuple[str, int, int, bool, int, int]] = []
    text: list[str] = []
    links = 0
    # Open elements: name, holds no text, mark (2: article, 1: other, 0: none),
    # is named.
    open_: list[tuple[str, bool, int, bool]] = []
    # The named element around each, by number; the innermost open one.
    above, inner = [0], 0
    count: Counter[str] = Counter()
    hidden = link = 0
    marks = [0, 0, 0]
    at, n = 0, len(html)

    def end_line():
        nonlocal links
        if text:
            line = " ".join("".join(text).split())
            if line:
                lines.append((line, links, 2 if marks[2] else 1 if marks[1] else 0, any(count[h] for h in HEADINGS),
                              2 if count["p"] else int(any(count[t] for t in TEXTS)), inner))
            text.clear()
        links = 0

    def close(k):
        """Close the open elements from the k-th on."""
        nonlocal hidden, link, inner
        if any(x[3] for x in open_[k:]):
            end_line()
        for name, none, mark, named in reversed(open_[k:]):
            if named:
                inner = above[inner]
            hidden -= none
            link -= name == "a"
            marks[mark] -= 1
            count[name] -= 1
        del open_[k:]

    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not hidden:
            piece = unescape(html[at:end])
            text.append(piece)
            if link:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            end_line()
        elif name in SPACED and not hidden:
            text.append(" ")
        if m[1]:
            if count[name]:
                close(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            continue
        if name in RAW:
            # Its content is no markup: on to the end tag.
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not m[3].endswith("/"):
                at = stop.end() if stop else n
            continue
        if name in VOID:
            continue
        if name in BLOCKS and open_ and open_[-1][0] == "p":
            close(len(open_) - 1)
        for k in range(len(open_) - 1, -1, -1) if name in ENDS else ():
            if open_[k][0] in ENDS[name]:
                break
            if open_[k][0] == name or name in ("dt", "dd") and open_[k][0] in ("dt", "dd"):
                close(k)
                break
        none, article, named = _kind(name, m[3], bool(marks[2]))
        # Names on inline elements are not weighed against what they hold.
        none, named = none or named and name not in BLOCKS, named and name in BLOCKS
        if (none or named) and not hidden:
            if name in BLOCKS:
                end_line()
            lines.extend([("", 0, 0, False, 0, inner)] * WINDOW)
        mark = (2 if name == "article" else 1) if article else 0
        open_.append((name, none, mark, named))
        if named:
            above.append(inner)
            inner = len(above) - 1
        count[name] += 1
        hidden += none
        link += name == "a"
        marks[mark] += 1
    end_line()
    shown = _overruled(lines, above)
    return [x[:5] for x in lines if x[5] in shown]


def surges(lengths: list[int], headings: list[bool], sentences: list[bool]) -> list[bool]:
    """Which lines are text by the distribution of lengths."""
    n = len(lengths)
    sums = [sum(lengths[i:i + WINDOW]) for i in range(max(1, n - WINDOW + 1))]
    least = min(SURGE, max(sums, default=0) / 2)
    near = [False] * n
    for i, total in enumerate(sums):
        if total and total >= least:
            near[i:i + WINDOW] = [True] * len(near[i:i + WINDOW])
    kept = [False] * n
    i = 0
    while i < n:
        j = i
        while j < n and near[j]:
            j += 1
        own = [k for k in range(i, j) if lengths[k] and (lengths[k] * WINDOW >= least or sentences[k])]
        if own:
            first = min([k for k in range(i, own[0]) if lengths[k] and headings[k]], default=own[0])
            for k in range(first, own[-1] + 1):
                kept[k] = lengths[k] > 0
        i = j + 1
    follows = False  # the next line is kept
    for k in range(n - 1, -1, -1):
        if lengths[k]:
            kept[k] = follows = kept[k] or headings[k] and follows
    return kept


def _weights(lines: list[tuple[str, int, int, bool, int]], sentences: list[bool]) -> list[int]:
    """What each line counts in the sums."""
    best = max((mark for line, _, mark, _, _ in lines if line), default=0)
    out = []
    for (line, links, mark, heading, kind), sentence in zip(lines, sentences, strict=True):
        listed = links > LINK_SHARE * len(line) and not (mark and (heading or kind == 2))
        if mark < best or listed:
            out.append(0)
        else:
            out.append(max(len(line), SURGE) if mark == 2 and line and (kind or sentence) else len(line))
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    lines = lines_of(html) if html else []
    sentences = [bool(_SENTENCE.search(x[0])) for x in lines]
    kept = surges(_weights(lines, sentences), [x[3] for x in lines], sentences)
    return "\n\n".join(x[0] for x, keep in zip(lines, kept, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the column ``out``: the main text of each page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([main_text(t) for t in texts], dtype=object)

    return pages.withColumn(out, run(F.col(html)))
