"""Near-duplicates and repeated passages against brute force."""

import random
from collections import Counter
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumen.llm import simhash as H
from lumen.llm import substrings as S
from lumen.llm.graph import components


def naive_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, edges):
    above = list(range(n))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_fingerprints():
    rng = random.Random(0)
    words = ["The", "a", "É", "x1", "foo,", " wide", "\x1cq"]
    texts = [None, "", " \t\x0b\r\n", "One", "one TWO three"] + [
        rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    assert all(H.fingerprint(t) == naive_fingerprint(t) for t in texts)
    long = " ".join(rng.choice(words) for _ in range(70_003))
    assert H.fingerprint(long) == naive_fingerprint(long)


@pytest.mark.parametrize("max_bits", [4, 1, 0])
def test_links_match_brute_force(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = []
    for i in range(700):
        fp = centres[i % 12] if i < 600 else rng.integers(0, 2**64, dtype=np.uint64)
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            fp ^= np.uint64(1) << np.uint64(b)
        fps.append(fp)
    fps = np.array(fps + fps[:40] + [np.uint64(0)] * 3, np.uint64)
    n = len(fps)
    edges = [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= max_bits).tolist()]
    expected = roots(n, edges)
    prints = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "id long, fp long")
    got = {r.id: r.component_id for r in H.linked(spark, prints, max_bits).collect()}
    assert [got[i] for i in range(n)] == expected


def test_links_without_contraction(spark, monkeypatch):
    """The join alone finds every link too."""
    monkeypatch.setattr(H, "REACH", 0)
    test_links_match_brute_force(spark, 4)


def test_the_link_join_broadcasts_nothing(spark):
    """Its sides list each node many times, but are sized as the nodes."""
    nodes = spark.range(1000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("comp"))
    plan = H._links(nodes, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    names = rng.sample(range(1000), 300)
    edges = list(zip(names[:100], names[1:100])) + [(names[100], x) for x in names[101:200]] + [
        (rng.choice(names[200:]), rng.choice(names[200:])) for _ in range(60)]
    index = sorted(names)
    expected = roots(300, [(index.index(a), index.index(b)) for a, b in edges])
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: index[expected[index.index(x)]] for x in touched}


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(tuple(r) for r in H.near_duplicates(odd_docs).select("doc_id", "component_id").fillna(-1).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6)]
    kept = H.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6]
    for empty in (H.near_duplicates(no_docs), H.drop_near_duplicates(no_docs), S.repeated_passages(no_docs)):
        assert empty.collect() == []
    assert S.repeated_passages(odd_docs).collect() == []


def naive_chain(anchors, k, cost):
    """Score of the best chain, by trying every predecessor."""
    best = []
    for i, (x, y) in enumerate(anchors):
        best.append(k + max([0] + [best[j] - cost * (x - a + y - b) for j, (a, b) in enumerate(anchors[:i]) if a < x and b < y]))
    return max(best)


def test_chains_have_the_best_score():
    rng = random.Random(7)
    for _ in range(300):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))})
        best = S.chains([x for x, _ in anchors], [y for _, y in anchors])[0]
        score = S.K * len(best) - S.GAP_COST * sum(c - a + d - b for (a, b), (c, d) in zip(best, best[1:]))
        assert score == pytest.approx(naive_chain(anchors, S.K, S.GAP_COST))
        assert all(a < c and b < d for (a, b), (c, d) in zip(best, best[1:]))


def test_equal_words_is_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randint(0, 12))]) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.equal_words(a, b) == t[-1][-1]


def test_planted_passages(spark, monkeypatch):
    rng = random.Random(9)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows, planted = prose(60), [], set()
    for i in range(80):
        words = prose(rng.randint(60, 200))
        if i % 4 == 0:  # whole; with a word replaced, left out or added every 15
            at, copy = rng.randrange(len(words)), list(passage)
            if i % 8 == 4:
                for p in range(50, 0, -15):
                    copy[p:p + 1] = rng.choice([[], ["other"], ["other", copy[p]]])
            words[at:at] = copy
            planted.add(i)
        rows.append((i, " ".join(words)))
    rows += [(100, "same " * 300), (101, "Same, " * 200), (102, rows[1][1]), (103, rows[1][1]), (None, rows[1][1]), (1, rows[1][1])]
    planted |= {100, 101, 1, 102, 103}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for parts in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = S.repeated_passages(docs).collect()
        assert {r.doc for r in found} | {r.partner for r in found} == planted
        assert all(r.partner < r.doc and r.equal >= S.IDENTITY * max(r.end - r.start, r.partner_end - r.partner_start) for r in found)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    whole = {(r.doc, r.start, r.end, r.partner) for r in found}
    n = len(rows[1][1].split())
    assert {(102, 0, n, 1), (103, 0, n, 1)} <= whole


def plain_links(rows):
    """Pairs (id, x, head, y) of seeds (hash, id, place), document by document."""
    out, runs = [], {}
    for h, i, p in sorted(rows):
        runs.setdefault(h, {}).setdefault(i, []).append(p)
    for docs in runs.values():
        order = sorted(docs)
        for n, i in enumerate(order[1:], 1):
            for other in {order[0], order[n - 1]}:
                out += [(i, x, other, docs[other][min(k, len(docs[other]) - 1)]) for k, x in enumerate(docs[i])]
    return sorted(out)


def test_links_match_python():
    rng = random.Random(3)
    for n in (0, 1, 5, 40, 300):
        rows = sorted({(rng.randrange(6), rng.randrange(8), rng.randrange(50)) for _ in range(n)})
        h, ids, at = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        if n:
            assert sorted(zip(*(c.tolist() for c in S._links(h, ids, at)))) == plain_links(rows)


@pytest.mark.parametrize(("ranges", "local"), [(1, 16), (4, 16), (8, 3), (2, 1)])
def test_blocks_and_ranges_lose_no_seed(monkeypatch, ranges, local):
    """Blocks link documents beyond the first ones of a hash by themselves."""
    monkeypatch.setattr(S, "BLOCK_WORDS", 900)
    monkeypatch.setattr(S, "LOCAL", local)
    rng = random.Random(ranges)
    passage = [f"p{i}" for i in range(50)]
    texts = [(rng.randrange(-10**12, 10**15), " ".join([f"w{rng.randrange(10**4)}" for _ in range(30)] + (passage if k % 2 else ["q"] * 20)))
             for k in range(60)]
    frames = [pd.DataFrame(texts[k:k + 7], columns=["id", "text"]) for k in range(0, 60, 7)]
    packed = pd.concat(S._block_rows(ranges)(iter(frames)))
    assert set(packed.part) <= set(range(ranges))
    got = set()
    for _, part in packed.groupby("part"):
        t = S._range_pairs(pa.Table.from_pandas(part, preserve_index=False)).to_pydict()
        got |= {(i, at >> 32, head, at & 0xFFFFFFFF) for i, head, at in zip(t["id"], t["head"], t["at"])}
    read, rows = S.Words(), set()
    for i, text in texts:
        words = read(text)
        for at, h in (S.seeds(words), S.seeds(words, S.LONG, S.LONG_W), S.strobes(words)):
            rows |= {(x, i, p) for x, p in zip(h.tolist(), at.tolist())} if len(words) >= S.MIN_WORDS else set()
    if local == 16 and max(Counter(h for h, _ in {(h, i) for h, i, _ in rows}).values()) <= 16:
        assert got == set(plain_links(rows))
    # Every document with an earlier holder of a seed has a partner for it.
    first = {}
    for h, i, _ in rows:
        first[h] = min(first.get(h, i), i)
    assert {(i, p) for h, i, p in rows if i != first[h]} == {(i, x) for i, x, _, _ in got}
    assert all(head < i for i, _, head, _ in got)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(0)
    for kind in (np.uint32, np.int32, np.uint64):
        for n in (0, 1, 1000):
            x = rng.integers(0, np.iinfo(kind).max, n, dtype=kind)
            assert (S._unpacked(S._packed(x), kind) == x).all()


def test_words_of_texts_read_together():
    """As the pattern finds and zlib hashes them, whatever lies in one array."""
    rng = random.Random(2)
    parts = ["Ab_9", "\u00c4\u00d6", "\u0130x", "\u03a3", "\u5b57\u5b57", "\U0001d538", "\u0301", "\U0001f600", "'", " ", "\n", "-", "\x00", "\u00a0", "x" * 40, "\u00fc" * 20]
    texts = [None, "", " ", "\u03a3", "a" * 33, "end", "\u00e9", ""]
    texts += ["".join(rng.choices(parts if k % 2 else ["Ab", " ", "c_1", "."], k=rng.randrange(60))) for k in range(200)]
    plain = [[zlib.crc32(w.encode()) for w in re.findall(r"\w+", (t or "").lower())] for t in texts]
    for size in (1, 50, 10 ** 6):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(S, "READ_CHARS", size)
            assert [w.tolist() for w in S.Words().each(texts)] == plain
    assert [S.Words()(t).tolist() for t in texts[:40]] == plain[:40]
    known = S.Words().known
    assert all(bool(re.match(r"\w", chr(c))) == known[c] for c in range(0, 0x110000, 7))


def test_seeds_of_several_documents():
    """Those of each document alone: no seed reaches over its ends."""
    rng = np.random.default_rng(6)
    for few in (3, 10 ** 9):
        docs = [rng.integers(0, few, n).astype(np.uint32) for n in [*range(S.MIN_WORDS, S.MIN_WORDS + 12), 300, S.MIN_WORDS, 90]]
        for some in (docs, docs[:1], docs[5:6], docs[-3:]):
            number, at, h = S.seeds_of(some)
            got = sorted(zip(number.tolist(), at.tolist(), h.view(np.int64).tolist()))
            assert got == sorted((n, x, y) for n, d in enumerate(some) for xs, ys in S.all_seeds(d) for x, y in zip(xs.tolist(), ys.tolist()))
            # Within a hash: documents in order, places in order.
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            key = number[order] * 10 ** 6 + at[order]
            assert (np.diff(key)[same] >= 0).all()


def edited(rng, words, share):
    """A copy with that share of the words replaced, left out or doubled."""
    out = []
    for w in words:
        r = rng.random()
        out += [w] if r >= share else [[f"e{rng.randrange(10**6)}"], [], [w, f"e{rng.randrange(10**6)}"]][int(r / share * 3)]
    return out


@pytest.mark.parametrize(("length", "quotes", "words"), [(60, 6, 14), (200, 20, 18)])
def test_quotes_do_not_hide_a_changed_copy(spark, length, quotes, words):
    rng = random.Random(length)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(length)
    copy = list(passage)
    for p in rng.sample(range(length), round(length * 0.075)):
        copy[p] = f"changed{p}"
    rows = []
    for i in range(quotes):
        at = rng.randrange(length - words)
        rows.append((i, " ".join(prose(60) + passage[at:at + words] + prose(60))))
    rows += [(100, " ".join(prose(70) + passage + prose(70))), (101, " ".join(prose(50) + copy + prose(50)))]
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc, r.partner) for r in found if r.equal >= 0.85 * length} == {(101, 100)}


def test_recall_of_changed_passages(spark):
    """Against every pair of documents that were given a copy of one passage,
    as a brute-force alignment finds them."""
    rng = random.Random(21)

    def prose(n):
        return [f"w{int(rng.paretovariate(0.9)) % 5000}" for _ in range(n)]
    rows, copies = [], []
    for p in range(40):
        passage = prose(rng.randint(50, 150))
        for k in range(2):
            copy = edited(rng, passage, rng.choice([0, 0.05, 0.1, 0.15])) if k else passage
            before = prose(rng.randint(20, 150))
            copies.append((p, len(rows), before, copy))
            rows.append((len(rows), " ".join(before + copy + prose(rng.randint(20, 150)))))
        for _ in range(3):  # quotes of parts
            at = rng.randrange(len(passage) - 12)
            rows.append((len(rows), " ".join(prose(60) + passage[at:at + 12] + prose(60))))
    rng.shuffle(rows)
    ids = {old: new for new, (old, _) in enumerate(rows)}
    found = S.repeated_passages(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(5)).collect()
    got = {(r.doc, r.partner) for r in found}
    read, wanted = S.Words(), []
    for (p, i, _, a), (q, j, _, b) in zip(copies[::2], copies[1::2], strict=True):
        assert p == q
        same = S.equal_words(read(" ".join(a)), read(" ".join(b)))
        if same >= S.IDENTITY * max(len(a), len(b)) and min(len(a), len(b)) >= S.MIN_WORDS:
            wanted.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    assert len(wanted) >= 35
    assert sum(w in got for w in wanted) >= 0.95 * len(wanted)
    assert all(r.equal >= S.IDENTITY * max(r.end - r.start, r.partner_end - r.partner_start) for r in found)


def test_passages_grow_to_their_ends(spark):
    """Also where only the middle of a long passage has seeds of this pair."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(900)]
    around = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(6)]
    # Earlier documents hold both ends, so that these have other heads.
    rows = [(1, " ".join(passage[:430])), (2, " ".join(passage[470:])), (3, " ".join(around[0] + passage + around[1])),
            (4, " ".join(passage[:430] + around[2])), (5, " ".join(passage[470:] + around[3])),
            (6, " ".join(around[4] + passage + around[5]))]
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (6, 3, 40, 940, 40, 940, 900) in {(r.doc, r.partner, r.start, r.end, r.partner_start, r.partner_end, r.equal) for r in found}


def test_one_head_for_a_run_in_many_partitions(spark):
    """Borders fall at another document for every seed of a shared passage."""
    rng = random.Random(4)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(90):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((i, " ".join(words + (passage if i % 3 == 0 else []))))
    # One seed with many places in each of these, also over borders.
    rows += [(i, "same " * 70) for i in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = S.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {(r.doc, r.partner, r.start, r.end, r.partner_start, r.partner_end) for r in found}
    # A long seed at the edge of the passage need not be one of document 0.
    assert got >= {(i, 0, 60, 120, 60, 120) for i in range(3, 90, 3)} | {(i, 100, 0, 70, 0, 70) for i in range(101, 110)}
    assert {g[0] for g in got} == {*range(3, 90, 3), *range(101, 110)} and len(got) < 100


def test_parts_do_not_hide_a_whole_passage(spark):
    """Every short seed of the later documents has a document with a part as head."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]

    def around(part):
        return " ".join([f"w{rng.randrange(10**6)}" for _ in range(50)] + part + [f"w{rng.randrange(10**6)}" for _ in range(50)])
    rows = [(1, around(passage[:35])), (2, around(passage[25:])), (3, around(passage)), (4, around(passage))]
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc, r.partner, r.start, r.end) for r in found} == {(4, 3, 50, 110)}


def test_long_seeds_name_their_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, 200).astype(np.uint32)
    at, h = S.seeds(words, S.LONG, 1)
    assert at.tolist() == list(range(200 - S.LONG + 1)) and len(set(h.tolist())) == len(h)
    for i in (0, 7, 155):
        assert S.seeds(words[i:i + S.LONG], S.LONG, S.LONG_W)[1].tolist() == [h[i]]
        for j in range(S.LONG):
            other = words[i:i + S.LONG].copy()
            other[j] += 1
            assert S.seeds(other, S.LONG, 1)[1][0] != h[i]
    some = S.seeds(words, S.LONG, S.LONG_W)[0]
    assert max(np.diff(some)) <= S.LONG_W and len(some) < len(at)


def test_copies_close_to_the_least_similarity(spark):
    rng = random.Random(12)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = prose(60), []
    for i in range(40):
        copy = list(passage)
        if i:  # one word in six replaced: 83 % equal
            for p in range(i % 6, 60, 6):
                copy[p] = f"other{i}x{p}"
        rows.append((i, " ".join(prose(40) + copy + prose(40))))
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc for r in found if r.partner == 0} == set(range(1, 40))
    assert all(r.equal >= S.IDENTITY * max(r.end - r.start, r.partner_end - r.partner_start) for r in found)


def test_chains_without_inner_anchors_align_alike():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a = rng.integers(0, 2**32, 150).astype(np.uint32)
        b = a.copy()
        b[rng.choice(150, 12, replace=False)] = 7
        b = np.delete(b, rng.choice(150, 3, replace=False))
        (_, x), (_, y) = S.seeds(a, S.K, 1), S.seeds(b, S.K, 1)
        anchors = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(y == x[i])]
        for chain in S.chains([i for i, _ in anchors], [j for _, j in anchors]):
            thin = S._without_inner(chain)
            whole, less = S.align(chain, a, b), S.align(thin, a, b)
            assert set(thin) <= set(chain) and whole[:2] == less[:2]
            assert [sum(p[n] for p in whole[2]) for n in range(3)] == [sum(p[n] for p in less[2]) for n in range(3)]


def test_plain_copies_need_no_chaining_and_batches_do_not_matter(monkeypatch):
    """Anchors close ahead of each other are one chain without a search; others
    give the chains that the search in both texts finds."""
    rng = random.Random(9)
    rows, want = [], []
    for pair in range(300):
        at = [(rng.randrange(90), rng.randrange(90)) for _ in range(6)] if pair % 3 == 0 else []
        x, y = rng.randrange(50), rng.randrange(50)
        for _ in range(rng.randrange(1, 30)):
            x, y = x + rng.randrange(1, (4, 20, 70)[pair % 3]), y + rng.randrange(1, (4, 20, 70)[pair % 3])
            at.append((x, y))
        at = sorted(at + at[:1])
        rows += [(pair // 2, pair % 2, x << 32 | y) for x, y in at]
        want += [(pair // 2, pair % 2, S._without_inner(part)) for chain in S.chains(*zip(*at))
                 for part in S.split_at_gaps(chain) if part[-1][0] - part[0][0] >= S.K]

    def found(taken, size):
        columns = np.array(taken, np.int64)
        parts = (pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns[s:s + size].T], schema=S._ANCHORS)
                 for s in range(0, len(columns), size))
        return sorted((r["id"], r["head"], list(zip(r["xs"], r["ys"]))) for b in S._chain_rows(parts) for r in b.to_pylist())
    for least, size in ((1, 7), (50, 13), (10 ** 6, 100)):
        monkeypatch.setattr(S, "CHAINED", least, raising=False)
        assert found(rows, size) == sorted(want)
    monkeypatch.delattr(S, "chains")
    copies = [(i, 0, x << 32 | x + 3) for i in range(40) for x in range(0, 60, 3)]
    assert found(copies, 11) == [(i, 0, S._without_inner([(x, x + 3) for x in range(0, 60, 3)])) for i in range(40)]


def test_pairs_of_one_number_are_chained_apart(spark, monkeypatch):
    """Large ids may share a number: their rows then come mixed, over batches."""
    far = 1 << 32
    pairs = [(1, 5), (0, 5 ^ far), (2, 1), (2, -far), (-3, -9), (far + 1, 7), (far * 9, far * 8)]
    ids, heads = (np.array(c, np.int64) for c in zip(*pairs))
    numbers = S._pair_number(ids, heads)
    assert numbers[0] == numbers[1] and len(set(numbers.tolist())) == len(pairs) - 1
    rows = spark.createDataFrame(pairs, "id long, head long").select("id", "head", S._pair_key().alias("n")).collect()
    assert {(r.id, r.head): r.n for r in rows} == dict(zip(pairs, numbers.view(np.int64).tolist()))
    anchors = [(i, head, x << 32 | x + 3 + n) for n, (i, head) in enumerate(pairs) for x in range(0, 60, 3)]
    random.Random(1).shuffle(anchors)
    columns = np.array(sorted(anchors, key=lambda a: S._pair_number(*(np.array([v], np.int64) for v in a[:2]))[0]), np.int64)
    monkeypatch.setattr(S, "CHAINED", 10)
    parts = (pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns[s:s + 7].T], schema=S._ANCHORS)
             for s in range(0, len(columns), 7))
    got = sorted((r["id"], r["head"], list(zip(r["xs"], r["ys"]))) for b in S._chain_rows(parts) for r in b.to_pylist())
    assert got == sorted((i, head, S._without_inner([(x, x + 3 + n) for x in range(0, 60, 3)])) for n, (i, head) in enumerate(pairs))


def test_a_range_unpacks_little():
    """Of hashes held once only the hash is unpacked, and pairs are sent in small batches."""
    rng = np.random.default_rng(8)
    rows, wanted = [], []
    for b in range(50):
        h = np.sort(rng.choice(1 << 31, 20_000, replace=False).astype(np.uint32) * 2 + 1)
        ids = np.sort(rng.integers(0, 100, len(h))) + b * 100
        at = rng.integers(0, 20_000, len(h)).astype(np.int32)
        h[:2_000] = np.arange(2_000) * 2  # these every block holds, once each
        order = np.argsort(h, kind="stable")
        h, ids, at = h[order], ids[order], at[order]
        wanted += zip(h.tolist(), ids.tolist(), at.tolist())
        rows.append((0, b * 100, S._packed(np.diff(h, prepend=np.uint32(0))), S._packed((ids - b * 100).astype(np.uint64)), S._packed(at), None))
    table = pa.Table.from_pandas(pd.DataFrame(rows, columns=["part", "base", "hash", "id", "place", "head"]), preserve_index=False)
    seeds = len(wanted)
    tracemalloc.start()
    try:
        got = S._range_pairs(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 28 * seeds  # 16 bytes are a seed's hash, id and place
    assert max(map(len, got.to_batches())) <= S.SENT_ROWS < len(got)
    t = got.to_pydict()
    assert sorted(zip(t["id"], (a >> 32 for a in t["at"]), t["head"], (a & 0xFFFFFFFF for a in t["at"]))) == plain_links(wanted)


def test_workers_get_few_bytes_at_a_time(spark):
    """Rows of long texts and packed seeds are many bytes each."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(5_000))) for i in range(600)]
    S.repeated_passages(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"n": [int(b["text"].str.len().sum())]})
    assert max(r.n for r in docs.mapInPandas(run, "n long").collect()) <= S.BATCH_BYTES + 50_000


def every_pair(docs):
    """Pairs (id, head) with a passage, all seeds of all pairs chained."""
    read, out = S.Words(), set()
    words = {i: read(t) for i, t in docs}
    found = {i: S.seeds(w) for i, w in words.items()}
    for i, (at, h) in found.items():
        for head, (places, other) in found.items():
            anchors = [(int(x), int(y)) for x, v in zip(at, h) for y in places[other == v]] if head < i else []
            for chain in S.chains(*zip(*anchors)) if anchors else ():
                for part in S.split_at_gaps(chain):
                    if part[-1][0] - part[0][0] >= S.K and S.passages(*S.align(part, words[i], words[head], margin=10 ** 4)):
                        out.add((i, head))
    return out


def test_quotes_on_both_sides_hide_no_pair(spark):
    """Every seed and strobe that 10 and 100 share has another document as first
    of its run and another before 100."""
    rng = random.Random(5)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(60)
    copy = [f"changed{p}" if p % 10 == 9 else w for p, w in enumerate(passage)]
    rows = [(10, prose(70) + passage + prose(70)), (100, prose(50) + copy + prose(50))]
    for k, at in enumerate(range(0, 21, 3)):
        rows += [(k, prose(60) + passage[at:at + 40] + prose(60)), (50 + k, prose(60) + copy[at:at + 40] + prose(60))]
    docs = [(i, " ".join(w)) for i, w in rows]
    assert every_pair(docs) == {(100, 10)}
    found = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc, r.partner) for r in found} == {(100, 10)}
    assert max(r.equal for r in found) >= 53


def test_events_are_sent_packed():
    """Some 20 bytes an event instead of 50; what comes back of a range are the
    events that documents have with other words between."""
    class Shared:
        def __init__(self, *value):
            self.value = value
    rng = np.random.default_rng(6)
    lines = [rng.integers(0, 2**32, 20, dtype=np.uint32) for _ in range(6)]
    docs = [(7 * i + 2**40, np.concatenate([p for k in rng.permutation(6)[:4] for p in (
        lines[k], rng.integers(0, 2**32, rng.integers(1, 4), dtype=np.uint32))] + [rng.integers(0, 2**32, 1000, dtype=np.uint32)]))
        for i in range(60)]
    none = np.zeros(0, np.int64)
    b = S._Block(docs, Shared(16, np.full(1 << 10, ~np.uint64(0))), 32, Shared(none, none, none))
    sides = b.outer(*[np.ones(len(b.h), bool)] * 2)
    sent = pa.Table.from_batches(S._event_rows(b, *sides, 4))
    assert sorted(sent["part"].to_pylist()) == [0, 1, 2, 3]
    held = [S._unpacked(v, S._EVENT) for v in sent["events"].to_pylist()]
    assert sent["events"].nbytes < 24 * sum(map(len, held))
    wanted = set()
    for rows in held:
        events = pd.DataFrame({"key": np.cumsum(rows["key"], dtype=np.uint64).view(np.int64), "between": rows["between"], "id": rows["id"]})
        several = events.groupby("key").agg({"between": "nunique", "id": "nunique"})
        wanted |= set(several.index[(several["between"] > 1) & (several["id"] > 1)])
    found = pa.concat_tables([S._meeting(Shared(none, none))(sent.slice(i, 1)) for i in range(4)]).to_pandas()
    assert set(found["key"]) == wanted and len(wanted) > 10
    size = dict(docs)
    assert all(i in size and 0 <= x <= x2 < len(size[i]) for i, x, x2 in zip(found["id"], found["x"], found["x2"], strict=True))


def test_a_class_hides_no_other_passage(spark):
    """As before, but 10 and 100 share another passage too and so are in one
    class: the one that others' quotes hide is listed as well."""
    rng = random.Random(5)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, plain = prose(60), prose(80)
    copy = [f"changed{p}" if p % 10 == 9 else w for p, w in enumerate(passage)]
    rows = [(10, prose(70) + passage + prose(70) + plain), (100, plain + prose(50) + copy + prose(50))]
    for k, at in enumerate(range(0, 21, 3)):
        rows += [(k, prose(60) + passage[at:at + 40] + prose(60)), (50 + k, prose(60) + copy[at:at + 40] + prose(60))]
    docs = [(i, " ".join(w)) for i, w in rows]
    for every in (docs, docs + [(100, " ".join(prose(70) + plain))]):
        found = S.repeated_passages(spark.createDataFrame(every, "doc_id long, text string").repartition(3)).collect()
        assert {(r.doc, r.partner) for r in found} == {(100, 10)}
        assert {(r.partner_start, r.equal) for r in found if r.start < 40} == {(200, 80)}
        assert [r for r in found if r.start <= 135 and r.end >= 185 and abs(r.partner_start - 70) <= 5 and r.equal >= 53]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_link_of_common_lines_is_lost(spark, monkeypatch, seed):
    """Documents of the same few lines, with other words between: each line is
    in most of them, and pairs of them share passages that no third one has.
    Whom any pair's passage links is in one class, and nobody else."""
    monkeypatch.setattr(S, "BLOCK_WORDS", 3_000)
    monkeypatch.setattr(S, "LOCAL", 4)
    rng = random.Random(seed)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines, docs = [prose(rng.randint(8, 24)) for _ in range(11)], []
    for i in rng.sample(range(-500, 500), 90):
        words = prose(rng.randint(0, 30))
        for line in rng.sample(lines, 5):
            words += edited(rng, line, rng.choice([0, 0, 0.1])) + prose(rng.choice([0, 0, 1, 2, 3, 25]))
        docs.append((i, " ".join(words + prose(50))))
    wanted = every_pair(docs)
    found = S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).persist()
    got = {(r.doc, r.partner) for r in found.collect()}
    index = {i: n for n, i in enumerate(sorted(i for i, _ in docs))}
    root = roots(len(docs), [(index[a], index[b]) for a, b in got])
    assert len(wanted) >= 5
    assert [p for p in wanted if root[index[p[0]]] != root[index[p[1]]]] == []
    assert all(r.equal >= S.IDENTITY * max(r.end - r.start, r.partner_end - r.partner_start) for r in found.collect())
    order = sorted(index)
    assert {(r["doc"], r["class"]) for r in S.passage_classes(found).collect()} == {
        (i, order[root[index[i]]]) for p in got for i in p}
