"""Personal data, secrets and benchmark spans against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumen.llm import decontaminate as D
from lumen.llm import pii as P
from lumen.llm import secrets as S


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_matches_python(spark):
    rng = random.Random(3)
    parts = ["a", "b@c.de", "@", ".", "x.y", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 123-4567", "+1", " ", "-", "5", "é", "GB82WEST12345698765432", "123-45-6789", "ssn ", "\n", "_", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.find_pii(docs).collect():
        got = [(s.start, s.kind_no, s.end) for s in r.pii]
        assert [s for s in got if s[1] < P.BASE_KINDS] == base_pii(r.text), r.text
        assert all(r.text[s.start:s.end] == s.match for s in r.pii)


def test_pii_validators_and_context(spark):
    rows = [(1, "iban GB82WEST12345698765432 or GB82WEST12345698765433"), (2, "tax number 123-45-6789"),
            (3, "part 123-45-6789 of it"), (4, "call +1 (743) 555-3824 now"), (5, "+1 (743) 555-3824")]
    got = {r.doc_id: r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", P.span_text(F.col("pii")).alias("spans"), "pii").collect()}
    assert got[1].spans == "iban:5:27"
    assert got[2].spans == "ssn:11:22" and got[3].spans == ""
    assert got[4].pii[0].score > got[5].pii[0].score


def test_pii_long_runs_are_linear(spark):
    texts = {"a" * 300_000: 0, "1" * 300_000: 0, "1.1." * 20_000: 10_000, "a." * 150_000: 0, "+1" * 100_000: 0,
             "1 " * 100_000: 0, "a@b.c " * 10_000: 10_000}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.n for r in P.find_pii(docs).select("text", F.size("pii").alias("n")).collect()} == texts


A = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(d):
    out = [(m.start(), 0, m.end()) for m in A.finditer(d) if len(m[1]) >= 6]
    for r, (p, ok) in enumerate(((rb"AKIA[A-Z0-9]+", lambda n: n >= 20), (rb"[0-9a-f]+", lambda n: n >= 24),
                                 (rb"gh[pousr]_[A-Za-z0-9]+", lambda n: n == 40), (rb"xox[baprs]-[A-Za-z0-9-]+", lambda n: n >= 15),
                                 (rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda n: True),
                                 (rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda n: True)), 1):
        out += [(m.start(), r, m.end()) for m in re.finditer(p, d) if ok(m.end() - m.start())]
    return sorted(out)


def test_secret_scan_matches_regular_expressions():
    scan = S.Scan(S.RULES, S.compiled())
    rng = random.Random(1)
    parts = ["token", "=", ":", " ", '"', "password", "AKIA", "ABCD1234", "0123456789ab", "abc", "ghp_", "x" * 36, "xoxb-", "eyJ",
             ".", "-", "é", "api_key", "Secret", "abcdefgh", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "PRIVATE", "\n"]
    for _ in range(8000):
        d = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))).encode()
        assert scan.spans(d) == plain_secrets(d), d


def test_secret_spans_and_mask(spark):
    text = "é token=abcdef12 and é " + "ab12" * 8 + " end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.find_secrets(docs).select("doc_id", S.span_text(F.col("secrets")).alias("s")).collect()}
    assert got[1].s == "assign:2:16,hex:23:55" and got[2].s == "" and got[3].s == ""
    assert text[23:55] == "ab12" * 8
    masked = {r.doc_id: r.text for r in S.mask_secrets(docs).collect()}
    assert masked == {1: "é [assign] and é [hex] end", 2: None, 3: "clean"}


def brute_hits(doc, items, window):
    hit, names = set(), set()
    for name, words in items:
        m = min(len(words), window)
        for p in range(len(words) - m + 1 if m else 0):
            for q in range(len(doc) - m + 1):
                if doc[q:q + m] == words[p:p + m]:
                    hit |= set(range(q, q + m))
                    names.add(name)
    runs = [e - q for q in range(len(doc)) for e in range(q + 1, len(doc) + 1)
            if any(doc[q:e] == w[p:p + e - q] for _, w in items for p in range(len(w)))]
    return hit, names, max(runs, default=0)


def test_suffix_automaton_matches_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        window, letters = rng.choice([2, 3, 5]), [b"a", b"b", b"c"][:rng.choice([2, 3])]
        items = [(str(k) if rng.random() < .9 else None, [rng.choice(letters) for _ in range(rng.randint(0, 12))]) for k in range(4)]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 30))]
        longest, spans, names = D.stream(doc, D.build([i for i in items if i[1]], window), window)
        assert ({x for s, e in spans for x in range(s, e)}, names, longest) == brute_hits(doc, items, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 25])
def test_decontamination_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    w = [f"w{i}" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(w[:20])), (2, " ".join(w[40:60])), (3, "Short Item"), (4, None), (5, "--"),
                                   (None, " ".join(w[60:75])), (1, " ".join(w[80:95]))], "item_id long, text string")
    rows = [(1, "x " + " ".join(w[5:16]) + " y"), (2, " ".join(w[:9])), (3, "a short ITEM, here"), (4, None),
            (5, " ".join(w[45:75])), (6, " ".join(w[80:90]) + " tail tail tail tail tail tail tail tail tail tail tail tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.hits.n_hit, r.hits["items"], r.hits.longest) for r in D.find_hits(docs, bench).collect()}
    assert got == {1: (11, ["1"], 11), 2: (0, [], 9), 3: (2, ["3"], 2), 4: (0, [], 0),
                   5: (30, ["2"], 15), 6: (10, ["1"], 10)}
    left = {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()}
    assert left == {2: " ".join(w[:9]), 3: "a , here", 4: None, 6: " tail" * 12}


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one word")], "item_id long, text string")
    n, columns = odd_docs.count(), odd_docs.columns
    for f, out in ((lambda d: P.find_pii(d, out="found"), ["found"]), (lambda d: S.find_secrets(d, out="found"), ["found"]),
                   (lambda d: D.find_hits(d, bench, out="found"), ["found"]), (S.mask_secrets, [])):
        assert f(odd_docs).columns == columns + out and f(odd_docs).count() == n
        assert len(f(odd_docs).collect()) == n and f(no_docs).collect() == []
    assert sorted(r.doc_id or 0 for r in D.decontaminate(odd_docs, bench).collect()) == [1, 2, 3, 5, 6]
    assert D.decontaminate(odd_docs, bench.limit(0)).count() == n
    assert D.decontaminate(odd_docs, bench).columns == columns


def test_blocks_of_items_are_one_python_node(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 5)
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "c d e x", 8), (2, "c d e x", 8), (3, None, 9)], "doc_id long, text string, row int")
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a b c", "c d e", "d e f", "x y z", "b c d", "p q r", "s t u", "e x"])],
                                  "item_id string, text string")
    found = D.find_hits(docs, items, window=3, cut=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2  # the node, once more in the adaptive plan's first form
    assert found.columns == [*docs.columns, "hits"]
    got = {r.doc_id: (r.row, r.hits.n_words, r.hits.longest, r.hits.spans, r.hits["items"], r.hits.n_hit, r.hits.left) for r in found.collect()}
    assert got == {1: (7, 6, 3, [0, 6], ["0", "1", "2", "4"], 6, ""), 2: (8, 4, 3, [0, 4], ["1", "7"], 4, ""), 3: (9, 0, 0, [], [], 0, None)}
