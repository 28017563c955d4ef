"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram of letters is
bound from its letters' vectors, each rotated by its place in the n-gram and
then multiplied; a text bundles (adds) the vectors of all its n-grams. A
language's prototype bundles its texts' vectors, each of length one. A text
is given the language of the prototype with the largest cosine.

Prototypes learn from every document that may be learned from: tasks add up
whole numbers, so that the sums do not depend on the order, and one vector a
language reaches the driver.

Defined cases: a null text or one without letters is ``und`` with score 0, as
is every text when nothing was learned; ties go to the smaller language name;
null languages are not learned from; texts of any length are read whole;
repeated documents each get the same answer; other columns are kept and may
have any name but ``out``.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import small_batches

DIMENSIONS = 1024
GRAM = 3
SEED = 20_111
# A text's vector of length one is summed in steps of 1 / UNIT.
UNIT = 1 << 20
# n-gram vectors that a worker remembers (4 KB each).
REMEMBERED = 8_192
# Texts that are bundled together.
TOGETHER = 64

def _class(wanted) -> str:
    """The code points that are wanted, as the inside of a character class."""
    codes = [c for c in range(sys.maxunicode + 1) if wanted(chr(c))]
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


# Letters, and the marks (vowel signs, accents) that stand with them. What
# counts as a word character and is neither letter nor digit (\u00b2, \u00bd, \u2460) is none.
_LETTER = rf"[^\W\d_{_class(lambda c: c.isalnum() and not c.isalpha() and not c.isdecimal())}]"
_WORD = re.compile(rf"{_LETTER}+(?:[{_class(lambda c: unicodedata.category(c)[0] == 'M')}]+{_LETTER}*)*")
_ASCII_WORD = re.compile("[a-z]+")


class Profiles:
    """Texts to bundled vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM) -> None:
        self.d, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((REMEMBERED, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = np.random.default_rng([SEED, code]).integers(0, 2, self.d).astype(np.float32) * 2 - 1
            if len(self.letters) < REMEMBERED:
                self.letters[code] = v
        return v

    def bound(self, key: int) -> np.ndarray:
        """Vector of the n-gram whose letters' codes are 21 bits each."""
        v = np.ones(self.d, np.float32)
        for place in range(self.gram):
            v *= np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
        return v

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(n-grams, how often each occurs) of a text; None without letters."""
        text = (text or "").lower()
        words = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
        if not words:
            return None
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        keys = codes[self.gram - 1:].copy()
        for place in range(1, self.gram):
            keys |= codes[self.gram - 1 - place:-place] << 21 * place
        return np.unique(keys, return_counts=True)

    def places(self, keys: np.ndarray) -> list[int]:
        """Where the table has the vectors of so many n-grams as it holds."""
        keys = keys.tolist()
        if len(self.rows) + sum(k not in self.rows for k in keys) > REMEMBERED:
            self.rows.clear()
        for key in keys:
            if key not in self.rows:
                self.table[len(self.rows)] = self.bound(key)
                self.rows[key] = len(self.rows)
        return [self.rows[k] for k in keys]

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The text's vector of length one; None without letters."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Each text's vector of length one; None without letters. Texts are
        bundled together: n-grams that they share are read once."""
        found = [self.grams(t) for t in texts]
        some = [i for i, f in enumerate(found) if f is not None]
        out: list[np.ndarray | None] = [None] * len(texts)
        for at in range(0, len(some), TOGETHER):
            part = some[at:at + TOGETHER]
            every = np.unique(np.concatenate([found[i][0] for i in part]))
            total = np.zeros((len(part), self.d), np.float64)
            for start in range(0, len(every), REMEMBERED):
                known = every[start:start + REMEMBERED]
                counts = np.zeros((len(part), len(known)), np.float32)
                for row, i in zip(counts, part, strict=True):
                    keys, n = found[i]
                    here = (keys >= known[0]) & (keys <= known[-1])
                    row[np.searchsorted(known, keys[here])] = n[here]
                total += counts @ self.table[self.places(known)]
            for i, v in zip(part, total, strict=True):
                norm = np.sqrt(v @ v)
                out[i] = v / norm if norm else v
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", allowed: Column | None = None) -> dict[str, list[int]]:
    """Prototype of each language: sums of its texts' vectors. allowed: which
    rows may be learned from."""
    small_batches(docs.sparkSession)
    if allowed is not None:
        docs = docs.where(allowed)
    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profile, sums = Profiles(), {}
        for b in batches:
            for name, v in zip(b["lang"], profile.many(b["text"].tolist()), strict=True):
                if v is not None:
                    sums[name] = sums.get(name, 0) + np.rint(v * UNIT).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [s.tolist() for s in sums.values()]})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    sums = (rows.mapInPandas(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
            .groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")))
    # One vector of DIMENSIONS numbers for each language.
    return {r["lang"]: [e["x"] for e in r["v"]] for r in sums.collect()}


def identify(docs: DataFrame, prototypes: dict[str, list[int]], text: str = "text", out: str = "language") -> DataFrame:
    """docs with the struct column ``out``: lang and score (cosine, 0 to 1)."""
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)
    matrix /= np.maximum(np.sqrt((matrix ** 2).sum(axis=1, keepdims=True)), 1e-300)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        profile = Profiles()

        def best(v):
            if v is None:
                return "und", 0.0
            cosines = matrix @ v
            k = int(cosines.argmax())
            return names[k], float(min(max(cosines[k], 0.0), 1.0))

        for texts in batches:
            vectors = profile.many(texts.tolist()) if names else [None] * len(texts)
            yield pd.DataFrame([best(v) for v in vectors], columns=["lang", "score"])

    return docs.withColumn(out, run(F.col(text)))
