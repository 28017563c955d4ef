"""Line dedup, phrase mining and the manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.llm import lines as L
from lumen.llm import manifest as M
from lumen.llm import phrases as P

WHITE = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ----------------------------------------------------------------------- lines

def plain_lines(rows, min_docs=2, min_chars=10):
    """(n_lines, n_dropped, kept) of each row (doc_id, text)."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    holders = defaultdict(set)
    for d, ls in split:
        for x in ls:
            holders[x.strip(WHITE).translate(ASCII_LOWER)].add(d)
    out = []
    for d, ls in split:
        kept = []
        for x in ls:
            key = x.strip(WHITE).translate(ASCII_LOWER)
            ids = holders[key]
            first = min((i for i in ids if i is not None), default=None)
            if len(key) < min_chars or len(ids) < min_docs or d == first:
                kept.append(x)
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def line_rows(rng, n):
    pool = ["The same long line here", "  the SAME long line here\t", "short", "ÄÖÜ ÄÖÜ ÄÖ", "äöü äöü äö", "", " ",
            "ten chars!", "nine char", "\r", "x" * 30] + [f"line number {i} of many" for i in range(12)]
    return [(i, rng.choice([None, "", *["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(8)]]))
            for i in range(n)]


def test_lines_match_python(spark):
    rows = line_rows(random.Random(1), 300)
    rows += rows[:20] + [(None, "the same long line here\nonly with no id at all"), (None, "only with no id at all"), (5, "another text")]
    got = L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", "text", "n_lines", "n_dropped", "kept").collect()
    want = [(d, t, *r) for (d, t), r in zip(rows, plain_lines(rows))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_lines_thresholds_and_one_hot_line(spark):
    rows = [(i, f"one very hot line\nown line number {i // 2}\nabc") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for least, chars in ((2, 10), (3, 10), (2, 3)):
        got = L.drop_repeated_lines(df, min_docs=least, min_chars=chars).select("doc_id", "kept").collect()
        want = {d: r[2] for (d, _), r in zip(rows, plain_lines(rows, least, chars))}
        assert dict(map(tuple, got)) == want


def test_lines_odd_tables(odd_docs, no_docs):
    got = L.drop_repeated_lines(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) < set(got.columns)
    assert [r.kept for r in rows] == [r.text or "" for r in rows]  # each line is short or has one holder
    assert L.drop_repeated_lines(no_docs).count() == 0


def test_lines_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.drop_repeated_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# -------------------------------------------------------------------- manifest

def plain_manifest(leaves, fan):
    """subroot by group, root, and a function from (group, index) to the proof
    and from a leaf to its root; leaves: group -> digests in order."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i:i + fan])) for i in range(0, len(now), fan)])
        return levels

    def steps(levels, i):
        for now in levels[:-1]:
            run = i - i % fan
            yield now[run:i], now[i + 1:run + fan]
            i //= fan

    trees = {g: tree(x) for g, x in leaves.items()}
    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in groups])

    def path(g, i):
        return [*steps(trees[g], i), *steps(top, groups.index(g))]
    return {g: t[-1][0] for g, t in trees.items()}, top[-1][0], path


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_manifest_matches_python(spark, fan):
    rng = random.Random(fan)
    langs = [None, "", "en", "de", "é", "z", "+", *[f"l{i}" for i in range(6)]]
    sizes = {"en": 150, "de": 65, None: 9, "z": 8}
    rows = [(g, rng.randint(-50, 500), rng.choice([None, "Text", "ßé"])) for g in langs for _ in range(sizes.get(g, 1))]
    rows += [(None, None, "x"), ("en", None, None), *rows[:3]]
    df = spark.createDataFrame(rows, "lang string, doc_id long, text string").withColumns({"path": F.lit(1), "i": F.lit(2), "h": F.lit(3)})
    leaves = df.withColumn("leaf", M.leaf(F.col("doc_id"), F.col("text")))
    got = M.manifest(leaves, fan=fan).withColumns({
        "proof": M.siblings(F.col("path")), "back": M.folded(F.col("leaf"), F.col("path"))}).collect()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for g, d, t in rows:
        groups[g].append((d is not None, d or 0, sha(field(d) + field(t))))
    ordered = {g: sorted(x) for g, x in groups.items()}
    subroot, root, path = plain_manifest({g: [x[2] for x in xs] for g, xs in ordered.items()}, fan)
    assert len(got) == len(rows)
    want = Counter()
    for g, xs in ordered.items():
        for i, (_, _, h) in enumerate(xs):
            want[g, h, subroot[g], "".join("".join(a + b) for a, b in path(g, i))] += 1
    assert Counter((r.lang, r.leaf, r.subroot, r.proof) for r in got) == want
    assert {r.root for r in got} == {root} == {r.back for r in got}


def test_manifest_finds_changes(spark):
    rows = [(i, "en" if i % 3 else "de", f"Row {i}" if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    leaves = df.withColumns({"leaf": M.leaf(F.col("doc_id"), F.col("text")),
                             "seen": M.leaf(F.col("doc_id"), F.when(F.col("doc_id") == 7, "row 7").otherwise(F.col("text")))})
    bad = M.manifest(leaves).where(M.folded(F.col("seen"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [7]


def test_manifest_small_tables(odd_docs, no_docs):
    leaves = odd_docs.withColumn("leaf", M.leaf(F.col("doc_id"), F.col("text")))
    rows = M.manifest(leaves).collect()
    assert len(rows) == odd_docs.count() and len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 3
    one = M.manifest(leaves.where("doc_id = 2")).collect()[0]
    assert one.leaf == one.subroot == one.root and one.path == []
    assert M.manifest(no_docs.withColumn("leaf", F.lit("x"))).count() == 0


def test_tampered_rows(spark):
    from lumen.llm.q_manifest import tampered
    df = spark.range(60).select(F.when(F.col("id") < 59, F.col("id")).alias("id"), F.lit("AÄz").alias("t"))
    for r in df.select("id", tampered(F.col("id"), F.col("t")).alias("t")).collect():
        hit = r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 0
        assert r.t == ("aÄz" if hit else "AÄz")


# --------------------------------------------------------------------- phrases

def plain_phrases(rows, top, min_count, absorbed=100, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inner = Counter()
        for p, a in found.items():
            for s in range(len(p)):
                for t in range(s + 2, len(p) + 1):
                    if t - s < len(p):
                        inner[p[s:t]] = max(inner[p[s:t]], a)
        kept = []
        for p, a in found.items():
            if p in inner and 100 * inner[p] >= absorbed * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "Été", "x-y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["New York City hall", "as far as I know", "w0 w1 rare pair", "a a a a a a", "Été w0 fin"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.15 else rng.choices(words, weights)[0] for _ in range(rng.randint(1, 60))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "  "]) for p in parts)))
    return rows


@pytest.mark.parametrize(("top", "least", "absorbed"), [(5, 4, 100), (40, 3, 100), (10_000, 4, 100), (30, 4, 60)])
def test_phrases_match_python(spark, monkeypatch, top, least, absorbed):
    monkeypatch.setattr(P, "CHUNK", 700)
    rows = phrase_rows(random.Random(top), 250) + [("xx", None), ("xx", ""), ("yy", "...\n"), (None, "und"), ("und", "one w0")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = P.collocations(df, top=top, min_count=least, absorbed=absorbed).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, top, least, absorbed)


def test_phrases_full_bit_tables_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "TABLE_BITS", 6)
    monkeypatch.setattr(P, "holds", lambda table, h: np.ones(len(h), bool))
    rows = phrase_rows(random.Random(9), 80)
    got = P.collocations(spark.createDataFrame(rows, "lang string, text string"), top=20, min_count=3).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 20, 3)


def test_phrases_ties_repeated_rows_and_empty(spark, odd_docs, no_docs):
    rows = [("en", "b c"), ("en", "d e"), ("en", "É ß"), ("en", "a f")] * 5
    got = P.collocations(spark.createDataFrame(rows, "lang string, text string"), top=3, min_count=5).collect()
    assert [(r.rank, r.phrase) for r in sorted(got)] == [(1, "a f"), (2, "b c"), (3, "d e")]
    assert P.collocations(no_docs).count() == 0
    found = {r.phrase: r.a for r in P.collocations(odd_docs, min_count=50).collect()}
    assert found["lorem ipsum lorem ipsum lorem"] == 39_998


def test_cut_score_is_exact(spark):
    big = [(10**17 + 7, 10**17 + 9, 10**17 + 11, 10**17 + 13), (123_456_789_012_345, 987_654_321_098_765, 777_777_777_777, 333_333_333_333_333)]
    df = spark.createDataFrame(big, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(P.cut_score(*(F.col(c) for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in big]


def test_bit_table_has_no_false_negatives(spark):
    words = [("en", f"w{i}") for i in range(3000)] + [("de", "x"), ("de", "x y")]
    singles = spark.createDataFrame([w for w in words if " " not in w[1]], "lang string, phrase string")
    table = P.bit_table(spark, singles).value
    for lang in ("en", "de"):
        assert P.holds(table, P.word_hashes(lang, [w.encode() for g, w in words if g == lang and " " not in w])).all()
    others = P.holds(table, P.word_hashes("en", [f"v{i}".encode() for i in range(5000)]))
    assert others.mean() < 0.1
