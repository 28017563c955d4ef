"""Secret scan: all rules as one minimal automaton, one pass over the bytes.

The combined automaton reads each byte of a text once and tells for which
rules a match ends there. Only where one ends, the rule's reversed automaton
walks back to the leftmost start and the rule's own automaton forward to the
longest end, as a regular expression engine without backtracking does. So
matches are leftmost, longest and do not overlap within a kind.

Transition arrays are compiled on the driver from the rules alone (a few
thousand states whatever the data) and broadcast.

Defined cases: a null or empty text has no spans; texts of any length are
scanned whole, byte offsets are turned into code points; repeated rows each
get their result; other columns are kept and may have any name but ``out``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.automaton import Dfa, alt, backward, compile_dfa, many, maybe, one_of, seq, word
from lumen.llm.common import small_batches


@dataclass(frozen=True)
class Rule:
    """kind, its expression, and a last check of a match (None: keep all)."""

    kind: str
    expr: tuple
    keep: Callable[[bytes], bool] | None = None


_ASSIGNED = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)""", re.S)


def _long_value(match: bytes) -> bool:
    return len(_ASSIGNED.fullmatch(match)[1]) >= 6


def _rules() -> tuple[Rule, ...]:
    quote, blanks = maybe(one_of("\"'")), many(one_of(" "))
    alnum = one_of("A-Z", "a-z", "0-9")
    token = one_of("A-Z", "a-z", "0-9", "_", "-")
    names = alt(*(word(w, any_case=True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    value = many(one_of("A-Z", "a-z", "0-9", "+", "/", "_", ".", "=", "-"), 1)
    # Only the hexadecimal rule counts inside the automaton, where a short run
    # would end a match at every other letter; more counters would multiply
    # its states. The other lengths are checked on the whole match.
    return (
        Rule("assign", seq(names, quote, blanks, one_of(":="), blanks, quote, value), _long_value),
        Rule("access", seq(word("AKIA"), many(one_of("A-Z", "0-9"), 1)), lambda m: len(m) >= 20),
        Rule("hex", many(one_of("0-9", "a-f"), 24)),
        Rule("github", seq(word("gh"), one_of("pousr"), word("_"), many(alnum, 1)), lambda m: len(m) == 40),
        Rule("slack", seq(word("xox"), one_of("baprs"), word("-"), many(one_of("A-Z", "a-z", "0-9", "-"), 1)),
             lambda m: len(m) >= 15),
        Rule("jwt", seq(word("eyJ"), many(token, 1), word("."), many(token, 1), word("."), many(token, 1))),
        Rule("pem", seq(word("-----BEGIN "), many(one_of("A-Z", " ")), word("PRIVATE KEY-----"))),
    )


RULES = _rules()
KINDS = tuple(r.kind for r in RULES)
BASE_KINDS = 3


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> list[tuple]:
    """Transition arrays: every rule with matches anywhere, then per rule its
    own (anchored), back (anchored, reversed) and alone (matches anywhere)."""
    exprs = [r.expr for r in rules]
    dfas = [compile_dfa(exprs, True), *(compile_dfa([e], False) for e in exprs),
            *(compile_dfa([backward(e)], False) for e in exprs), *(compile_dfa([e], True) for e in exprs)]
    return [(d.classes, d.step, d.accept, d.dead) for d in dfas]


class Scan:
    """The automata as linked rows, in a worker."""

    def __init__(self, rules: tuple[Rule, ...], arrays: list[tuple]) -> None:
        self.rules, n = rules, len(rules)
        every, *each = (Dfa(*a) for a in arrays)
        self.classes, self.all = every.classes, every.rows()
        rows = [d.rows(by_byte=True) for d in each]
        self.own, self.back, self.alone = rows[:n], rows[n:2 * n], rows[2 * n:]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """The one pass: (end, rules with a match that ends there)."""
        out = []
        row = self.all
        for i, c in enumerate(data.translate(self.classes)):
            row = row[c]
            if row[-1]:
                out.append((i + 1, row[-1]))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes, by start, then kind."""
        ends = self.ends(data)
        found = []
        for r, rule in enumerate(self.rules):
            done = fresh = 0
            for e, mask in ends:
                if not mask >> r & 1 or e <= done or e < fresh:
                    continue
                s = _furthest(self.back[r], data, range(e - 1, done - 1, -1))
                if s is None:
                    # It began inside the match before. Go on where the first
                    # one ends that begins after that.
                    fresh = _first(self.alone[r], data, done)
                    if fresh > e:
                        continue
                    s = _furthest(self.back[r], data, range(fresh - 1, done - 1, -1))
                done = _furthest(self.own[r], data, range(s, len(data))) + 1
                if rule.keep is None or rule.keep(data[s:done]):
                    found.append((s, r, done))
        return sorted(found)


def _furthest(row: list, data: bytes, places: range) -> int | None:
    """The last of the places up to which the bytes are accepted."""
    at = None
    for i in places:
        row = row[data[i]]
        if row[-1]:
            if row[-1] < 0:
                break
            at = i
    return at


def _first(row: list, data: bytes, start: int) -> int:
    """End of the first match after start; beyond the data if there is none."""
    for i in range(start, len(data)):
        row = row[data[i]]
        if row[-1]:
            return i + 1
    return len(data) + 1


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[int]:
    """Flat start, kind number, end with offsets in code points."""
    if not spans:
        return []
    if data.isascii():
        return [x for span in spans for x in span]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [int(x) for s, r, e in spans for x in (before[s], r, before[e])]


def _scan_udf(spark, rules: tuple[Rule, ...], work: Callable, kind: str):
    """A column function that applies work(scan, text) to each text."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(compiled(rules))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Scan(rules, shared.value)
        for texts in batches:
            yield pd.Series([work(scan, t) for t in texts], dtype=object)

    return run


def _found(scan: Scan, text: str | None) -> list[int]:
    data = (text or "").encode()
    return _points(data, scan.spans(data))


def _masked(scan: Scan, text: str | None) -> str | None:
    if not text:
        return text
    data, out, at = text.encode(), [], 0
    for s, r, e in scan.spans(data):
        if e > at:
            out += [data[at:max(s, at)], f"[{scan.rules[r].kind}]".encode() if s >= at else b""]
            at = e
    return b"".join([*out, data[at:]]).decode()


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the array column ``out``: start, kind_no (position in rules)
    and end (exclusive) of each span in code points, by start, then kind."""
    flat = _scan_udf(docs.sparkSession, rules, _found, "array<int>")(F.col(text))
    return docs.withColumn(out, flat).withColumn(out, F.transform(
        F.filter(F.col(out), lambda _, i: i % 3 == 0), lambda s, i: F.struct(
            s.alias("start"), F.get(F.col(out), i * 3 + 1).alias("kind_no"), F.get(F.col(out), i * 3 + 2).alias("end"))))


def mask_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in the text replaced by [kind]; overlapping
    secrets give one replacement. Texts without secrets stay as they are."""
    return docs.withColumn(text, _scan_udf(docs.sparkSession, rules, _masked, "string")(F.col(text)))


def span_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
