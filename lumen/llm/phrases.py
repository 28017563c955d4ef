"""Collocated phrases by best-first branch-and-bound growth.

A phrase of ``a`` occurrences, cut after its first k words into parts of l and
r occurrences, scores 1000 a n / (l r) for that cut, n being all words of the
language; its lowest-scoring cut counts. A part occurs at least as often as the
whole, so the score is at most 1000 n / f for the count f of any part, of the
first word and of the last in particular: rare words promise most.

1. Words are counted per language.
2. The frontier is opened by falling bound: words of at most ``limit``
   occurrences are open as ends of phrases. Pairs with an open word are
   counted; from pairs that are frequent enough, windows of up to LONGEST
   words are counted, ahead of an open first word and back from an open last
   one. Their prefixes and suffixes are all parts, and all phrases one word
   longer, of any phrase whose both ends are open, so these get exact scores
   and are tested against the longer phrases that may absorb them.
3. A language is settled when the last of its wanted phrases scores more than
   the bound of any word not open yet, so that not even a tie can follow, or
   when all words are open. Others go on with a higher limit: as far as the
   score of the last phrase asks, but at most STEP times the limit, so the
   rounds are the logarithm of the largest count at most.

Counting runs in Python workers, CHUNK words at a time, and is combined there
before the shuffle; sums and joins are Spark's. Workers know frequent and open
words and frequent pairs from bit tables of at most 2^TABLE_BITS bits, made
from hashes: a false positive costs rows, which exact counts then remove, and
never a result. Beyond some ten million words the tables fill up and prune
less; results stay the same.

Defined cases: a null or empty text has no words; a null language is ``und``;
repeated rows count again; ties are ordered by occurrences, then by the bytes
of the phrase; an empty table has no phrases; texts of any length are read
whole; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm.common import small_batches, written

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
# A phrase goes if a longer one has this share of its occurrences, in percent.
ABSORBED = 100
# The first limit in MIN_COUNTs, and how much a round may raise it.
STEP = 8
CHUNK = 4_000_000
TABLE_BITS = 27
UNKNOWN = "und"

_BREAK = b"."
_CODES = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_COUNTS = "lang string, phrase string, f long"


def words_of(text: str | None) -> list[bytes]:
    """Words, with a break of its own between pieces."""
    if not text:
        return []
    return text.encode().lower().translate(_CODES).replace(_BREAK, b" . ").split()


class _Chunk:
    """Words of one language as numbers; 0 is a break."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.codes[_BREAK]
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        words.append(_BREAK)
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def names(self) -> np.ndarray:
        out = np.empty(len(self.codes), object)
        out[:] = [w.decode() for w in self.codes]
        return out

    def hashes(self, lang: str) -> np.ndarray:
        return word_hashes(lang, list(self.codes))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    salt = lang.encode() + b"\0"
    return np.frombuffer(b"".join(blake2b(salt + w, digest_size=8).digest() for w in words), np.uint64)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX ^ b) * _ODD
    return h ^ h >> np.uint64(29)


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[str, _Chunk]]:
    held: dict[str, _Chunk] = {}
    n = 0
    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            words = words_of(text)
            if not words:
                continue
            if lang not in held:
                held[lang] = _Chunk()
            held[lang].add(words)
            n += len(words)
            if n >= size:
                yield from held.items()
                held, n = {}, 0
    yield from held.items()


# ------------------------------------------------------------------ bit tables

def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [hashes & mask, hashes >> np.uint64(64 - bits)]


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the table may have the hashes; false for none that it has."""
    found = np.ones(len(hashes), bool)
    for s in _slots(hashes, int(len(table) * 64).bit_length() - 1):
        found &= (table[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def bit_table(spark: SparkSession, phrases: DataFrame):
    """Broadcast bit table of phrases (lang, phrase) of one or two words: 16
    bits for each phrase, as long as that stays below 2^TABLE_BITS."""
    bits = min(TABLE_BITS, max(10, int(16 * phrases.count()).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                ends = [p.encode().split(b" ") for p in part["phrase"]]
                h = word_hashes(lang, [e[0] for e in ends])
                if len(ends[0]) > 1:
                    h = pair_hashes(h, word_hashes(lang, [e[1] for e in ends]))
                s = np.unique(np.concatenate(_slots(h, bits)))
                block, start = np.unique(s >> np.uint64(6), return_index=True)
                words = np.bitwise_or.reduceat(np.uint64(1) << (s & np.uint64(63)), start)
                yield pd.DataFrame({"block": block.astype(np.int64), "bits": words.view(np.int64)})

    blocks = phrases.mapInPandas(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[blocks["block"].to_numpy(np.int64)] = blocks["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table)


# -------------------------------------------------------------------- counting

def _rows(lang: str, phrases, counts) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "phrase": phrases, "f": counts})


def _summed(counts: DataFrame, *also: str) -> DataFrame:
    return counts.groupBy("lang", *also, "phrase").agg(F.sum("f").alias("f"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word."""
    chunk = CHUNK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, c in _chunks(batches, chunk):
            yield _rows(lang, c.names()[1:], np.bincount(c.ids(), minlength=len(c.codes))[1:])

    return _summed(texts.mapInPandas(run, _COUNTS))


def _pairs_with(ids: np.ndarray, frequent: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place, whether it and the next hold frequent words, and whether one
    of the two is open."""
    a, b = ids[:-1], ids[1:]
    return frequent[a] & frequent[b], is_open[a] | is_open[b]


def _known(c: _Chunk, lang: str, frequent, opened) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = c.hashes(lang)
    often = holds(frequent.value, hashes)
    often[0] = False
    return hashes, often, often & holds(opened.value, hashes)


def count_pairs(texts: DataFrame, frequent, opened) -> DataFrame:
    """(lang, phrase, f) of pairs of frequent words, at least one of them open."""
    chunk = CHUNK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, c in _chunks(batches, chunk):
            _, often, is_open = _known(c, lang, frequent, opened)
            ids, names, v = c.ids(), c.names(), len(c.codes)
            both, one = _pairs_with(ids, often, is_open)
            at = np.flatnonzero(both & one)
            codes, n = np.unique(ids[at] * v + ids[at + 1], return_counts=True)
            yield _rows(lang, names[codes // v] + " " + names[codes % v], n)

    return _summed(texts.mapInPandas(run, _COUNTS))


def _windows(ids: np.ndarray, allowed: np.ndarray, starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of 3 to LONGEST words from the starts, in the given
    direction and filled up with breaks, and how often each occurs.

    allowed: per place, whether the pair that begins there may be part of one.
    """
    here = np.flatnonzero(starts)
    rows = np.zeros((len(here), LONGEST), np.int64)
    rows[:, 0] = ids[here]
    going = np.ones(len(here), bool)
    for k in range(1, LONGEST):
        pair = here + (k - 1 if step > 0 else -k)
        going &= (pair >= 0) & (pair < len(allowed))
        going[going] = allowed[pair[going]]
        rows[going, k] = ids[here[going] + step * k]
    rows = rows[rows[:, 2] > 0]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    rows = rows[np.lexsort(rows.T)]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.diff(np.append(first, len(rows)))


def count_longer(texts: DataFrame, frequent, opened, pairs) -> DataFrame:
    """(lang, ahead, phrase, f) of phrases of 3 to LONGEST words that begin
    (ahead) or end with an open word and consist of frequent pairs; pairs
    without an open word are not known and taken for frequent."""
    chunk = CHUNK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, c in _chunks(batches, chunk):
            hashes, often, is_open = _known(c, lang, frequent, opened)
            ids, names, v = c.ids(), c.names(), len(c.codes)
            allowed, one = _pairs_with(ids, often, is_open)
            at = np.flatnonzero(allowed & one)
            codes, where = np.unique(ids[at] * v + ids[at + 1], return_inverse=True)
            allowed[at] = holds(pairs.value, pair_hashes(hashes[codes // v], hashes[codes % v]))[where]
            for step in (1, -1):
                rows, n = _windows(ids, allowed, is_open[ids], step)
                if len(rows):
                    phrases = [" ".join(names[r[r > 0][::step]]) for r in rows]
                    yield _rows(lang, phrases, n).assign(ahead=step > 0)

    windows = _summed(texts.mapInPandas(run, _COUNTS + ", ahead boolean"), "ahead")
    # Every window counts for its prefixes (ahead) or suffixes of 3 words or more.
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(3), F.size(words))
    parts = windows.select("lang", "ahead", "f", words.alias("words"), F.explode(sizes).alias("size"))
    part = F.when(F.col("ahead"), F.slice("words", F.lit(1), F.col("size"))).otherwise(
        F.slice("words", F.size("words") - F.col("size") + 1, F.col("size")))
    return _summed(parts.select("lang", "ahead", F.array_join(part, " ").alias("phrase"), "f"), "ahead")


# --------------------------------------------------------------------- scoring

def cut_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)), exact up to 38 digits."""
    a, n, l, r = (c.cast("decimal(18,0)") for c in (a, n, l, r))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), l * r)


def _scored(found: DataFrame, ahead: DataFrame, back: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases whose prefixes are in ahead
    and whose suffixes are in back."""
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"),
                        F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    cuts = cuts.join(ahead.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        back.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(sizes, "lang")
    score = cut_score(*(F.col(c) for c in ("a", "n", "l", "r")))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"),
                                              F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _not_absorbed(scored: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Rows without a longer phrase that has the share of their occurrences;
    one word longer is enough, since counts fall as phrases grow."""
    words = F.split("phrase", " ")
    inner = F.when(F.col("ahead"), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(
        F.slice(words, F.lit(2), F.size(words)))
    most = longer.select("lang", F.array_join(inner, " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(
        F.max("f").alias("most"))
    return scored.join(most, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP,
                 min_count: int = MIN_COUNT, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each
    language by score, occurrences (both falling) and phrase."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    every = written(spark, count_words(texts), "words")
    words = written(spark, every.where(F.col("f") >= min_count), "frequent-words")
    frequent = bit_table(spark, words)
    state = written(spark, every.groupBy("lang").agg(F.sum("f").alias("n")).withColumn(
        "limit", F.lit(STEP * min_count).cast("long")), "languages")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    done = None
    while True:
        here = texts.join(state.select("lang"), "lang", "left_semi")
        mine = words.join(state, "lang")
        opened = written(spark, mine.where("f <= limit").select("lang", "phrase", "f"), "open-words")
        known = bit_table(spark, opened)
        pairs = written(spark, count_pairs(here, frequent, known).where(F.col("f") >= min_count), "pairs")
        common = bit_table(spark, pairs)
        longer = written(spark, count_longer(here, frequent, known, common).where(F.col("f") >= min_count), "longer")
        for b in (known, common):
            b.unpersist()

        ends = opened.select("lang", F.col("phrase").alias("end"))
        found = pairs.unionByName(longer.where("ahead").drop("ahead"))
        for i in (1, -1):
            found = found.withColumn("end", F.element_at(F.split("phrase", " "), i)).join(ends, ["lang", "end"], "left_semi")
        short = mine.select("lang", "phrase", "f").unionByName(pairs)
        scored = _scored(found.drop("end"), *(short.unionByName(longer.where(F.col("ahead") == a).drop("ahead"))
                                              for a in (True, False)), state.select("lang", "n"))
        ranked = _not_absorbed(scored, longer, absorbed).withColumn("rank", F.row_number().over(order).cast("long"))
        first = written(spark, ranked.where(F.col("rank") <= top), "phrases")

        # What the words not open yet could still reach.
        closed = mine.where("f > limit").groupBy("lang").agg(F.min("f").alias("next"))
        last = first.where(F.col("rank") == top).select("lang", F.col("score").alias("least"))
        state = state.join(closed, "lang").join(last, "lang", "left")
        asked = F.expr("1000 * n div least")
        state = written(spark, state.where(F.col("least").isNull() | (F.col("least") <= F.expr("1000 * n div next"))).select(
            "lang", "n", F.greatest("next", F.least(STEP * F.col("limit"), F.coalesce(asked, STEP * F.col("limit")))).alias("limit")),
            "languages")
        settled = first.join(state.select("lang"), "lang", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if state.isEmpty():
            break
    frequent.unpersist()
    return done.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
