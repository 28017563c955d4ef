"""Query op5 and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.decontaminate import WINDOW, find_hits
from lumen.llm.registry import register, table

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL = rf"""
with d as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, least(len(w), {WINDOW}) as m, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as p from i where len(w) > 0)),
sizes as (select distinct m from win),
runs as (
  select rid, p, m, array_to_string(w[p:p + m - 1], ' ') as win
  from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as p from d, sizes where len(w) >= m)),
hit as (select rid, p, m, item_id from runs join win using (m, win)),
n as (select rid, count(distinct q) as n_hit
      from (select rid, unnest(range(p, p + m)) as q from (select distinct rid, p, m from hit)) group by rid),
items as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct rid, item_id::varchar as item from hit where item_id is not null) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (rid) left join items using (rid)"""


@register("op5_decontamination", SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every whole text of documents."""
    hit = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    return hit.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"))
