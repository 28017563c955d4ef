"""Snippet search and repository languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_snippets(snippets: DataFrame, q: str) -> DataFrame:
    """Snippets whose title or tags contain q, ignoring ASCII case.

    As in a SQL LIKE built from the raw text, ``%`` and ``_`` inside q act as
    wildcards (a backslash is just a backslash); null tags do not match."""
    pat = "%" + q.replace("\\", "\\\\") + "%"
    return (snippets.where(F.col("title").ilike(pat) | F.coalesce(F.col("tags").ilike(pat), F.lit(False)))
            .select("id", "title", "code", "tags"))


def owner_languages(repos: DataFrame) -> DataFrame:
    """Per owner, the repository count and the distinct non-empty
    languages (sorted; a set per owner is bounded by the language list and
    is merged map-side)."""
    lang = F.when(F.length(F.col("language")) > 0, F.col("language"))
    return (repos.groupBy("owner")
            .agg(F.count(F.lit(1)).alias("public_repos"),
                 F.sort_array(F.collect_set(lang)).alias("langs"))
            .select("owner", F.col("public_repos").cast("long"),
                    F.array_join("langs", ",").alias("languages"),
                    F.size("langs").cast("long").alias("n_languages")))
