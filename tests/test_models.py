"""Exact AUC, sums over a global order, label codes, bundles and drivers."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumen.functions.ranks import roc_auc, sums_before
from lumen.operators import model as M


def test_sums_before_match_python(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), k, rng.randint(-5, 9)) for k in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    got = {(r.g, r.k): r.v_before for r in sums_before(df, ["g"], ["k"], ["v"]).collect()}
    so_far, want = defaultdict(int), {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[g, k] = so_far[g]
        so_far[g] += v
    assert got == want
    assert sums_before(df.limit(0), [], ["k"], ["v"]).count() == 0


def plain_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_roc_auc_matches_all_pairs(spark):
    rng = random.Random(7)
    rows = [(g, rng.random() < 0.3, round(rng.random(), d)) for g, d in (("tied", 1), ("free", 9)) for _ in range(300)]
    rows += [("one class", True, 0.5), ("one class", True, 0.7), (None, True, 0.2), (None, False, 0.9),
             ("zeros", True, 0.0), ("zeros", False, -0.0)]
    odd = [("free", None, 0.5), ("free", True, None), ("free", True, float("nan")), ("nothing", None, None)]
    df = spark.createDataFrame([(g, None if y is None else int(y), s) for g, y, s in rows + odd], "g string, y int, s double")
    got = {r.g: r for r in roc_auc(df.repartition(5), "y", "s", by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        want = plain_auc([(y, s) for h, y, s in rows if h == g])
        assert got[g].auc == (None if want is None else pytest.approx(want, abs=1e-12))
    assert "nothing" not in got and got["one class"].negatives == 0
    whole = roc_auc(df, "y", "s").first()
    assert whole.auc == pytest.approx(plain_auc([(y, s) for _, y, s in rows]), abs=1e-12)
    empty = roc_auc(df.limit(0), "y", "s").first()
    assert (empty.auc, empty.positives, empty.negatives) == (None, 0, 0)


def test_no_task_sorts_all_scores_or_values(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), F.rand(1).alias("s"), F.col("id").cast("string").alias("t"))
    for out in (roc_auc(df, "y", "s"), M.label_codes(df, ["t"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
        # Over rows: inside a stretch; over the table of stretches: by key.
        assert any("__part" in line.split("windowspecdefinition")[1] for line in windows)


def test_codes_join_back(spark):
    rng = random.Random(2)
    values = [f"v{i:04}" for i in range(700)]
    rows = [(i, rng.choice(values) if i % 3 else "hot", rng.choice(["x", None, "y"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, a string, b string").repartition(5)
    coded, codes = M.encode_labels(df, ["a", "b"])
    vocab = {"a": sorted({r[1] for r in rows}), "b": ["nan", "x", "y"]}
    assert {(r.column, r.value): r.code for r in codes.collect()} == {(c, v): i for c, vs in vocab.items() for i, v in enumerate(vs)}
    want = {(k, vocab["a"].index(a), vocab["b"].index(b or "nan")) for k, a, b in rows}
    assert {tuple(r) for r in coded.select("k", "a", "b").collect()} == want


def churners(spark, n=3000):
    """churn follows driver; noise and text do not matter."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        driver = rng.random()
        rows.append((i, driver, rng.random(), rng.choice("abc"), int(driver + rng.gauss(0, 0.15) > 0.7)))
    return spark.createDataFrame(rows, "k long, driver double, noise double, text string, churn int").repartition(6)


def test_planted_driver_comes_first(spark, tmpdir_path):
    df = churners(spark)
    trained, test = M.fit_model(df, "churn", task="classification", features=["noise", "text", "driver"], key="k", trees=15,
                                depth=6, stratify=True)
    assert trained.metrics["auc"] > 0.85
    found = M.risk_drivers(trained, trained.data, "k", "churn").collect()
    assert found[0].feature == "driver" and found[0].auc_drop > 0.2
    assert all(abs(r.auc_drop) < 0.1 for r in found[1:])
    # The same whatever the partitions.
    again = M.risk_drivers(trained, trained.data.repartition(11), "k", "churn").collect()
    assert [r.feature for r in again] == [r.feature for r in found]
    assert [r.auc_drop for r in again] == pytest.approx([r.auc_drop for r in found], abs=1e-12)
    # A loaded bundle scores the same, unseen and missing text included.
    path = os.path.join(tmpdir_path, "bundle")
    M.save_model(trained, path)
    more = df.unionByName(spark.createDataFrame([(-1, 0.9, 0.1, "unseen", 1), (-2, 0.1, 0.1, None, 0)], df.schema))
    scores = [{r.k: r.risk_score for r in M.risk_scores(M.score_batch(t, more, keep=["k"])).collect()}
              for t in (trained, M.load_model(path))]
    assert scores[0] == scores[1] and len(scores[0]) == 3002


def test_drivers_take_one_job_series(spark):
    df = churners(spark, 400).withColumns({f"n{i}": F.rand(i) for i in range(6)})
    counts = []
    for features in (["driver"], ["driver", "noise", *[f"n{i}" for i in range(6)]]):
        trained, _ = M.fit_model(df, "churn", task="classification", features=features, key="k", trees=3, depth=3)
        tag = f"drivers-{len(features)}"
        spark.sparkContext.setJobGroup(tag, tag)
        M.risk_drivers(trained, trained.data, "k", "churn")
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)))
        spark.sparkContext.setJobGroup("rest", "rest")
    assert counts[0] == counts[1]


def test_forests_use_every_core(spark):
    """Rows of a few bytes lay in one task, for the fit and for the scores."""
    df = churners(spark, 500).coalesce(1)
    trained, _ = M.fit_model(df, "churn", task="classification", features=["noise", "text", "driver"], key="k", trees=3, depth=3,
                             stratify=True)
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and trained.data.rdd.getNumPartitions() >= cores
    sizes = [len(p) for p in trained.data.rdd.glom().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 2 * 500 / cores
