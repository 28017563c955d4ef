"""Factors of items and their nearest neighbours."""

import random
import tracemalloc

import numpy as np

from lumen.operators import catalog as G


def bought(spark, seed=1, orders=600):
    """Two groups of items that are bought together, and one item with a twin."""
    rng = random.Random(seed)
    rows = []
    for o in range(orders):
        group = [f"{'ab'[o % 2]}{i}" for i in rng.sample(range(12), 5)]
        rows += [(o, i) for i in group]
        if "a3" in group:
            rows.append((o, "twin of a3"))
    rows += [(10_000, f"{g}{i}") for g in "ab" for i in range(12)] * 3 + [(None, "a1"), (3, None)]
    return spark.createDataFrame(rows, "ord long, item string").repartition(5)


def test_neighbours_match_brute_force_and_are_symmetric(spark):
    factors = G.item_factors(bought(spark), rank=6, iterations=4)
    table = {r.item: np.array(r.factor) for r in factors.collect()}
    assert len(table) == 25 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in table.values())
    got = {}
    for r in G.similar_items(factors, factors, n=4, at_once=7).collect():
        got.setdefault(r.target, []).append((r.rank, r.item, r.similarity))
    for t, v in table.items():
        want = sorted((-round(float(v @ w), 12), i) for i, w in table.items() if i != t)[:4]
        assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in sorted(got[t])]
        assert [r for r, _, _ in sorted(got[t])] == [1, 2, 3, 4]
    pairs = {(t, i): s for t, rows in got.items() for _, i, s in rows}
    assert all(abs(pairs[i, t] - s) < 1e-9 for (t, i), s in pairs.items() if (i, t) in pairs)


def test_planted_twin_and_groups(spark):
    factors = G.item_factors(bought(spark))
    found = {(r.target, r.rank): r.item for r in G.similar_items(factors, factors, n=3).collect()}
    assert found["twin of a3", 1] == "a3" and found["a3", 1] == "twin of a3"
    # Fewer factors than groups have items, so that a factor stands for a group.
    factors = G.item_factors(bought(spark), rank=2)
    found = {(r.target, r.rank): r.item for r in G.similar_items(factors, factors, n=3).collect()}
    same = [found[t, 1][0] == t[0] for t in (f"{g}{i}" for g in "ab" for i in range(12) if (g, i) != ("a", 3))]
    assert np.mean(same) > 0.9


def test_blocks_of_the_fit_grow_with_the_pairs(spark, monkeypatch):
    """A block held a tenth of all pairs, however many; so few pairs stay in ten."""
    asked, inner = [], G.ALS

    def seen(**kw):
        asked.append((kw["numUserBlocks"], kw["numItemBlocks"]))
        return inner(**kw)
    monkeypatch.setattr(G, "ALS", seen)
    few = bought(spark, orders=40)
    G.item_factors(few, rank=2, iterations=1)
    monkeypatch.setattr(G, "PAIRS_A_BLOCK", 15)
    pairs = few.dropna().distinct().count()
    factors = G.item_factors(few)
    assert asked == [(10, 10), (-(-pairs // 15),) * 2] and pairs > 150
    assert factors.count() == 25


def test_rows_meet_all_cells_in_little_memory():
    rng = np.random.default_rng(2)
    x, centers = rng.normal(size=(5000, 4)), rng.normal(size=(2000, 4))
    tracemalloc.start()
    cell, far = G._nearest_cells(x, centers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    apart = np.sqrt(((x[:300, None] - centers) ** 2).sum(axis=2))
    assert (cell[:300] == apart.argmin(axis=1)).all() and np.allclose(far[:300], apart.min(axis=1))
    assert peak < 20e6


def test_similar_items_of_empty_tables(spark):
    lines = bought(spark, orders=10)
    none = G.item_factors(lines.limit(0))
    assert none.count() == 0 and G.similar_items(none, lines.select("item")).count() == 0
    factors = G.item_factors(lines, rank=3, iterations=2)
    assert G.similar_items(factors, lines.select("item").limit(0)).count() == 0
    strangers = spark.createDataFrame([("unknown",)], "item string")
    assert G.similar_items(factors, strangers).count() == 0


def test_cells_find_what_brute_force_finds(spark):
    """Factors in clusters, alone, repeated, and not of length 1."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 5)), np.repeat(rng.normal(size=(12, 5)), 60, axis=0)
                        + rng.normal(size=(720, 5)) * np.repeat([0, 1e-7, 1e-3], 240)[:, None]])
    x[:1500] /= np.linalg.norm(x[:1500], axis=1)[:, None]
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, factor array<double>").repartition(7)
    wanted = [i for i in range(len(x)) if i % 9 == 0]
    targets = spark.createDataFrame([(i,) for i in wanted] * 2 + [(None,), (-5,)], "item long")
    for n, at_once in ((1, 50), (4, 1000)):
        got = {}
        for r in G.similar_items(factors, targets, n=n, at_once=at_once).collect():
            got.setdefault(r.target, []).append((r.rank, r.item, r.similarity))
        scores = np.round(x @ x.T, 12)
        assert sorted(got) == wanted
        for t in wanted:
            want = sorted((-scores[t, i], i) for i in range(len(x)) if i != t)[:n]
            assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in sorted(got[t])]


def test_most_factors_are_not_compared(spark, monkeypatch):
    """Jobs do not grow with the targets, nor the scores with targets times items."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(1500, 8)), 2, axis=0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, factor array<double>").repartition(4)
    jobs, scored, inner = [], spark.sparkContext.accumulator(0), G._best

    def counted(scores, floors, n):
        scored.add(scores.size)
        return inner(scores, floors, n)
    monkeypatch.setattr(G, "_best", counted)
    for few in (10, 3000):
        spark.sparkContext.setJobGroup(f"similar-{few}", f"similar-{few}")
        found = G.similar_items(factors, factors.where(f"item < {few}").select("item"), n=1).collect()
        assert all(r.item == r.target ^ 1 for r in found) and len(found) == few
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"similar-{few}")))
        spark.sparkContext.setJobGroup("rest", "rest")
    assert abs(jobs[0] - jobs[1]) <= 2 and 0 < scored.value < 0.3 * 3000 * 3000
