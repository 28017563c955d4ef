"""Query op8 and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.registry import register, table
from lumen.llm.secrets import BASE_KINDS, KINDS, find_secrets, span_text

_NAMES = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
                  for w in ("password", "passwd", "secret", "token", "api_?key"))
_RE = {
    "assign": rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "github": "gh[pousr]_[A-Za-z0-9]+",
    "slack": "xox[baprs]-[A-Za-z0-9-]+",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
_VALID = {
    "assign": rf"""length(regexp_extract(m, '{_RE["assign"]}', 2)) >= 6""",
    "access": "length(m) >= 20",
    "hex": "length(m) >= 24",
    "github": "length(m) = 40",
    "slack": "length(m) >= 15",
}


def _kind_sql(kind: str) -> str:
    return f"""
    select rid, {KINDS.index(kind)} as kind_no, '{kind}' as kind, pos as s, pos + length(m) as e
    from (
      select rid, m, before + sum(step) over (partition by rid order by i) - step as pos
      from (
        select rid, i, hits[i] as m, length(gaps[i]) as before, length(gaps[i]) + length(hits[i]) as step
        from (select rid, gaps, hits, unnest(range(1, len(hits) + 1)) as i
              from (select rid, string_split_regex(text, '{_RE[kind]}') as gaps,
                           regexp_extract_all(text, '{_RE[kind]}') as hits from d))))
    where {_VALID.get(kind, "true")}"""


SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
spans as ({' union all '.join(_kind_sql(k) for k in KINDS)}),
per as (
  select rid,
    count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access,
    count(*) filter (kind_no = 2) as n_hex, count(*) as n_spans,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) filter (kind_no < {BASE_KINDS}) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) as spans
  from spans group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
from d left join per using (rid)"""


@register("op8_secrets", SQL)
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    secrets = F.col("secrets")

    def n(kind):
        number = KINDS.index(kind)
        return F.size(F.filter(secrets, lambda s: s["kind_no"] == number)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(n(k) for k in KINDS[:BASE_KINDS]),
        F.sha2(span_text(F.filter(secrets, lambda s: s["kind_no"] < BASE_KINDS)), 256).alias("base_sha256"),
        span_text(secrets).alias("spans"), F.size(secrets).cast("long").alias("n_spans"))
