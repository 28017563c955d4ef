"""Personal data: regular expressions propose, validators confirm, context scores.

Built from DataFrame functions only. Per kind the text is split at the
matches: the lengths of the gaps and of the matches give every offset, the
gap before and after a match is its context. No row is shuffled.

Patterns use possessive quantifiers and look-behinds where those cannot
change a match, so that a run of a million digits or letters is read once
instead of once from each of its characters.

Defined cases: a null or empty text has no spans; a text of any length is
scanned whole; repeated rows each get their result; other columns of the
input are kept and may have any name but ``out``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import let

# Kinds in the order in which ties of start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = 4

# What proposes a span of each kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}

# A text without this character cannot hold a match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}

# Score of a confirmed match without context, and the words that raise it
# when they stand within CONTEXT characters before or after the match.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
WORDS = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|addr|login",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
CONTEXT = 40
RAISE = 0.3
# Added kinds are reported from this score on; base kinds always are.
LEAST = 0.5

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _mod97(m: Column) -> Column:
    """Remainder of the rearranged account number, letters as 10 to 35."""
    moved = F.concat(F.substring(m, 5, 34), F.substring(m, 1, 4))

    def step(acc, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(m) == 1
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.lit(True)


BLOCK = 64
SPANS = "array<struct<start:int,kind_no:int,end:int,match:string,score:double>>"


def _offsets(lens: Column) -> Column:
    """Sum of all earlier elements for each element of an array of ints.

    Sums of blocks first, so that the work stays far below the square of the
    number of matches in a long text.
    """
    def by_block(x):
        n_blocks = F.ceil(F.size(x) / F.lit(BLOCK)).cast("int")
        numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
        return let(
            F.transform(numbers, lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, v: a + v)),
            lambda sums: let(
                F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, v: a + v)),
                lambda heads: F.transform(x, lambda _, i: F.get(heads, F.floor(i / BLOCK).cast("int")) + F.aggregate(
                    F.slice(x, i - i % BLOCK + 1, i % BLOCK), F.lit(0), lambda a, v: a + v))))
    return let(lens, by_block)


def _of_kind(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order, as an array of structs."""
    pattern, number = PATTERNS[kind], KINDS.index(kind)

    def spans(p):
        gaps, hits = p["gaps"], p["hits"]
        lens = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        return let(_offsets(lens), lambda starts: F.transform(hits, lambda h, i: F.struct(
            (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"),
            F.lit(number).alias("kind_no"),
            (F.get(starts, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
            h.alias("match"),
            (F.lit(SCORES[kind]) + F.when(
                F.lower(F.concat_ws(" ", F.substring(F.get(gaps, i), -CONTEXT, CONTEXT),
                                    F.substring(F.get(gaps, i + 1), 1, CONTEXT))).rlike(WORDS[kind]), RAISE)
             .otherwise(0.0)).alias("score"))))

    proposed = F.struct(F.split(text, pattern, -1).alias("gaps"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    kept = F.filter(let(proposed, spans), lambda s: _confirmed(kind, s["match"]) & (
        F.lit(number < BASE_KINDS) | (s["score"] >= LEAST)))
    can = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.isNotNull()
    return F.coalesce(F.when(can, kept), F.array().cast(SPANS))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with the array column ``out``: start, kind_no (position in KINDS),
    end (exclusive), match and score of each span, by start, then kind.

    Offsets count code points. Matches of one kind never overlap; matches of
    different kinds may.
    """
    col = F.col(text)
    every = F.concat(*(_of_kind(col, k) for k in KINDS))
    return docs.withColumn(out, F.array_sort(every))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
