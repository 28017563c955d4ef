"""Query op11 and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.lines import MIN_CHARS, MIN_DOCS, drop_repeated_lines
from lumen.llm.registry import register, table

_WHITE = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

SQL = f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from d),
k as (select *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as first from k where length(key) >= {MIN_CHARS}
      group by key having count(distinct coalesce(doc_id::varchar, '-')) >= {MIN_DOCS}),
m as (select rid, doc_id, line, place, r.key is not null and doc_id is distinct from first as gone
      from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from m group by rid, doc_id"""


@register("op11_lines", SQL)
def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
