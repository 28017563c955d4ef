"""Corpus pipeline: documents to a weighted training sample.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the docs of the next. All but the last
return the columns of documents.

Without SQL: fitting, fingerprints and raking cannot be stated in it; tests
hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.common import fresh, held_out, written
from lumen.llm.decontaminate import decontaminate
from lumen.llm.mixing import mix
from lumen.llm.registry import table
from lumen.llm.secrets import mask_secrets
from lumen.llm.simhash import MAX_BITS, SHINGLE, drop_near_duplicates
from lumen.llm.toxicity import fit, score


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; all documents where no
    label can be learned from."""
    weights = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("doc_id")))
    if not weights:
        return docs
    name = fresh(docs, "toxicity")
    return score(docs, weights, out=name).where(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return drop_near_duplicates(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in benchmark items; documents that
    are mostly such spans go."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _counted(mask_secrets(docs))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their tokens, topic, weight and probability."""
    return mix(docs).where("sampled").drop("sampled")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secrets", hide_secrets),
    ("mixing", sample_mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
