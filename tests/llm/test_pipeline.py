"""The corpus pipeline, stage by stage, against plain Python."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lumen.llm import decontaminate as D
from lumen.llm import secrets as S
from lumen.llm import simhash as H
from lumen.llm import toxicity as T
from lumen.llm.common import held_out, written
from lumen.llm.queries import QUERIES
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
        if i % 6 == 0:
            text = f"nasty {text} vile"
        if i % 10 == 1:
            text += " token=abcdef123456"
        if i % 12 == 2:
            text += ". " + item + " end"
        if i % 15 == 4:
            text = rows[-1][1]
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s1"]), len(text)))
    rows += [(900, item, "en", "s0", len(item)), (901, None, None, None, None), (902, "", "en", "s1", 0),
             (None, words[0], "en", "s1", 5), rows[7]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_plain_python(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "benchmark decontamination", "secrets", "mixing"]

    def run(name, docs):
        out = written(spark, stages[name](spark, docs, corpus), "test")
        return out, sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)

    labels = {i: int(i % 6 == 0) for i in range(240)}
    rows = [tuple(r) for r in docs.collect()]
    allowed = {r[0] for r in docs.where(~held_out(F.col("doc_id"))).select("doc_id").collect()}
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit("toxicity"), "doc_id")).collect()}
    known = sorted(((order[r[0]], r[1], labels[r[0]]) for r in rows if r[0] in labels and r[0] in allowed))
    weights = T.train((t, y) for _, t, y in known)
    features = T.Features()

    def logit(text):
        return weights.get(T.BIAS, 0.0) + sum(weights.get(int(i), 0.0) for i in features(text))
    docs, got = run("toxicity", docs)
    rows = [r for r in rows if logit(r[1]) < 0]
    assert got == sorted(rows, key=str)

    fps = [H.fingerprint(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    keep = set()
    todo = [i for i in range(len(rows)) if ids[i] is not None]
    while todo:
        group, new = set(), {todo[0]}
        while new:
            group |= new
            new = {j for j in todo if j not in group and any((fps[j] ^ fps[i]).bit_count() <= 4 for i in new)}
        keep.add(min(ids[i] for i in group))
        todo = [i for i in todo if i not in group]
    docs, got = run("near duplicates", docs)
    rows = sorted({r for r in rows if r[0] in keep} | {r for r in rows if r[0] is None}, key=str)
    assert got == rows and docs.columns == COLUMNS

    item = spark.read.parquet(f"{corpus}/benchmark.parquet").first().text
    automaton, cleaned = D.build([("1", D.words_of(item))]), []
    for r in rows:
        words = D.words_of(r[1])
        spans = D.stream(words, automaton)[1]
        if sum(e - s for s, e in spans) <= D.MAX_COVERAGE * len(words):
            text = D.without(r[1], spans) if spans else r[1]
            cleaned.append((r[0], text, r[2], r[3], len(text or "")))
    docs, got = run("benchmark decontamination", docs)
    assert got == sorted(cleaned, key=str) and not any(r[0] == 900 or item in (r[1] or "") for r in got)

    docs, got = run("secrets", docs)
    masked = [(r[0], r[1] and r[1].replace("token=abcdef123456", "[assign]"), r[2], r[3]) for r in cleaned]
    assert [r[:4] for r in got] == sorted(masked, key=str)
    assert all(r[4] == len(r[1] or "") for r in got)
    assert not any(S.Scan(S.RULES, S.compiled()).spans((r[1] or "").encode()) for r in got)

    mixed, sample = run("mixing", docs)
    assert mixed.columns == [*COLUMNS, "tokens", "topic", "weight", "probability"]
    assert set(sample) <= set(got) and 0 < len(sample) < len(got)
    assert np.isclose(sum(r.probability > 0 for r in mixed.collect()), len(sample))


@pytest.mark.parametrize("toxic", [[], [(1, 0, None)]])
def test_without_labels_no_document_is_toxic(spark, corpus, tmp_path, toxic):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_run_is_the_stages(spark, corpus):
    first = sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect()), key=str)
    again = sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect()), key=str)
    assert first == again and first


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
