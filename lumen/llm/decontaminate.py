"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised benchmark items.
Each document's words stream through it once; the state keeps the longest
run that ends at the current word and occurs in some item. Where that run is
at least a window long, or contains a whole item shorter than a window, the
words it covers are hit.

The automaton is built on the driver from at most ``BLOCK_WORDS`` benchmark
words at a time and broadcast (at most two states a word); a larger benchmark
takes one pass over the documents per block, whose spans are written and
merged at the end.

Defined cases: null, empty and word-free texts have no words and no hits;
null or word-free items have no windows; items with a null id hit words but
are not listed; an empty benchmark hits nothing; repeated documents each get
their result; repeated items count once; the documents' other columns are
kept and may have any name but ``out``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import fresh, small_batches, written

WINDOW = 10
# Benchmark words in one automaton (about 0.5 KB each in a worker).
BLOCK_WORDS = 500_000
# A document of which more than this share is hit goes whole.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "n_words long, longest int, spans array<int>, items array<string>, n_hit long, left string"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; a word is a run of ASCII letters, digits and all else
    beyond ASCII."""
    return _WORD.findall(text.encode().lower()) if text else []


def build(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> tuple:
    """(step, link, length, top, listed, short) of the items' automaton.

    step[s]: word -> state; link[s]: state of the longest suffix that occurs
    elsewhere; length[s]: its longest run. top[s]: for a state of runs of at
    least a window, the state of their last window; listed[top]: ids of the
    items that hold it. short[s]: (words, id) of the whole items below a
    window that end every run of s.
    """
    step, link, length = [{}], [-1], [0]

    def new(n: int, like: int = -1) -> int:
        step.append(dict(step[like]) if like >= 0 else {})
        link.append(link[like] if like >= 0 else 0)
        length.append(n)
        return len(step) - 1

    def split(p: int, word: bytes, q: int) -> int:
        """The state of p's longest run and word, apart from q's longer ones."""
        if length[p] + 1 == length[q]:
            return q
        copy = new(length[p] + 1, like=q)
        link[q] = copy
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    for _, words in items:
        last = 0
        for w in words:
            if w in step[last]:
                last = split(last, w, step[last][w])
                continue
            cur, p = new(length[last] + 1), last
            while p >= 0 and w not in step[p]:
                step[p][w] = cur
                p = link[p]
            if p >= 0:
                link[cur] = split(p, w, step[p][w])
            last = cur

    order = sorted(range(1, len(step)), key=length.__getitem__)
    top = [-1] * len(step)
    for s in order:
        if length[s] >= window:
            top[s] = top[link[s]] if length[link[s]] >= window else s
    listed: dict[int, set] = {}
    own: dict[int, list] = {}
    for name, words in items:
        s = 0
        for n, w in enumerate(words, 1):
            s = step[s][w]
            # A prefix may be a shorter run of a state with longer ones.
            if n >= window:
                listed.setdefault(top[s], set()).add(name)
        if 0 < len(words) < window:
            own.setdefault(s, []).append((len(words), name))
    short: list[tuple] = [()] * len(step)
    for s in order:
        if s in own or short[link[s]]:
            short[s] = tuple(dict.fromkeys([*own.get(s, ()), *short[link[s]]]))
    return step, link, length, top, {s: tuple(x) for s, x in listed.items()}, short


def stream(words: list[bytes], automaton: tuple, window: int = WINDOW) -> tuple[int, list, set]:
    """Longest run, hit spans of words (merged, end exclusive), item ids."""
    step, link, length, top, listed, short = automaton
    s = run = longest = 0
    spans: list[list[int]] = []
    names: set = set()
    for end, w in enumerate(words, 1):
        t = step[s].get(w)
        while t is None and s:
            s = link[s]
            run = length[s]
            t = step[s].get(w)
        if t is None:
            continue
        s = t
        run += 1
        if run > longest:
            longest = run
        cover = 0
        if run >= window:
            cover = window
            names.update(listed[top[s]])
        if short[s]:
            for n, name in short[s]:
                if n <= run:
                    names.add(name)
                    cover = max(cover, n)
        if cover:
            start = end - cover
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])
    return longest, spans, names


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list]:
    """Items as (id, words), so many at a time that they stay in the bound."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        if words:
            block.append((row[0], words))
            size += len(words)
    yield block


def _merged(*lists: list) -> list[list[int]]:
    """Union of spans, by start."""
    out: list[list[int]] = []
    for s, e in sorted((s, e) for spans in lists for s, e in spans):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([int(s), int(e)])
    return out


def without(text: str, spans: list) -> str:
    """text without the given spans of words (and what stands between the
    words of a span)."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.lower())]
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]]).decode()


def _hits_udf(spark, items: list, window: int, cut: bool):
    """Column function of a text."""
    shared = spark.sparkContext.broadcast(build(items, window))

    def hits(text):
        words = words_of(text)
        run, spans, found = stream(words, shared.value, window)
        left = (without(text, spans) if spans else text) if cut else None
        return (len(words), run, [x for span in spans for x in span], sorted(found.difference([None])),
                sum(e - s for s, e in spans), left)

    @F.pandas_udf(HITS)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([hits(t) for t in texts], columns=["n_words", "longest", "spans", "items", "n_hit", "left"])

    return udf


def _merged_udf(cut: bool):
    """Column function of a text and the spans of all blocks."""
    def hits(text, longest, flat, items):
        n = len(words_of(text))
        spans = [] if flat is None else _merged(list(zip(flat[::2], flat[1::2], strict=True)))
        left = (without(text, spans) if spans else text) if cut else None
        return (n, 0 if pd.isna(longest) else int(longest), [x for span in spans for x in span], [] if items is None else list(items),
                sum(e - s for s, e in spans), left)

    @F.pandas_udf(HITS)
    def udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([hits(*row) for row in zip(*b, strict=True)],
                               columns=["n_words", "longest", "spans", "items", "n_hit", "left"])

    return udf


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
              item_text: str = "text", window: int = WINDOW, out: str = "hits", cut: bool = False) -> DataFrame:
    """docs with the struct column ``out``: n_words, longest (longest run of
    words that occurs in an item), spans (start and end of the hit spans, in
    words, by start), items (ids as strings, sorted), n_hit (words) and, if
    cut, left (the text without the spans).

    One block of items takes one pass. Of several, each pass reads the texts
    from a table of numbered rows and writes what it has found, so that a task
    holds one automaton, whatever the number of blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = _blocks(benchmark, item, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn(out, _hits_udf(spark, first, window, cut)(F.col(text)))
    row = fresh(docs, "row")
    docs = written(spark, docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    found = None
    for block in chain((first, second), blocks):
        hit = docs.select(F.col(row).alias("row"), _hits_udf(spark, block, window, False)(F.col(text)).alias("h")).where(
            F.col("h.longest") > 0).select("row", "h.longest", "h.spans", "h.items")
        hit = written(spark, hit, "hits")
        found = hit if found is None else found.unionByName(hit)
    merged = found.groupBy(F.col("row").alias("_row")).agg(
        F.max("longest").alias("_longest"), F.flatten(F.collect_list("spans")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    names = {c: fresh(docs, c) for c in ("_row", "_longest", "_spans", "_items")}
    merged = merged.select(*(F.col(c).alias(n) for c, n in names.items()))
    both = docs.join(merged, docs[row] == merged[names["_row"]], "left")
    whole = _merged_udf(cut)(F.col(text), *(F.col(names[c]) for c in ("_longest", "_spans", "_items")))
    return both.withColumn(out, whole).drop(row, *names.values())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without hit spans; a document goes if more than max_coverage of
    its words are hit. Texts without hits stay as they are."""
    name = fresh(docs, "hits")
    hit = find_hits(docs, benchmark, text, item, item_text, window, out=name, cut=True)
    kept = hit.where(F.col(name)["n_hit"] <= F.lit(max_coverage) * F.col(name)["n_words"])
    return kept.withColumn(text, F.col(name)["left"]).drop(name)
