"""Query op6 and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.pii import BASE_KINDS, CONTEXT, KINDS, LEAST, RAISE, SCORES, WORDS, find_pii, span_text
from lumen.llm.registry import register, table

# The patterns of the contract, greedy and without look-around; \G and
# look-behinds of the operator only save time.
_RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3"
          " or coalesce(try_cast(right('0' || ltrim(p, '0'), 3) as int), 0) > 255)) = 0",
    "card": f"length({_DIGITS}) between 12 and 19 and "
            f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i:"
            " case when i % 2 = 1 then cast(d as int) when cast(d as int) > 4 then cast(d as int) * 2 - 9"
            " else cast(d as int) * 2 end)) % 10 = 0",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(m, 5) || left(m, 4), ''), lambda c:"
            " case when ascii(c) >= 65 then ascii(c) - 55 else ascii(c) - 48 end)),"
            " lambda a, v: case when v >= 10 then (a * 100 + v) % 97 else (a * 10 + v) % 97 end) = 1",
    "ssn": "not regexp_matches(m, '^(000|666|9)') and not regexp_matches(m, '-00-|-0000$')",
}


def _kind_sql(kind: str) -> str:
    no = KINDS.index(kind)
    return f"""
    select rid, {no} as kind_no, '{kind}' as kind, pos as s, pos + length(m) as e,
           {SCORES[kind]} + case when regexp_matches(lower(near), '{WORDS[kind]}') then {RAISE} else 0.0 end as score
    from (
      select rid, m, before + sum(step) over (partition by rid order by i) - step as pos, near
      from (
        select rid, i, hits[i] as m, length(gaps[i]) as before, length(gaps[i]) + length(hits[i]) as step,
               right(gaps[i], {CONTEXT}) || ' ' || left(gaps[i + 1], {CONTEXT}) as near
        from (select rid, gaps, hits, unnest(range(1, len(hits) + 1)) as i
              from (select rid, string_split_regex(text, '{_RE[kind]}') as gaps,
                           regexp_extract_all(text, '{_RE[kind]}') as hits from d))))
    where {_VALID[kind]} and ({no} < {BASE_KINDS} or score >= {LEAST})"""


SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
spans as ({' union all '.join(_kind_sql(k) for k in KINDS)}),
per as (
  select rid,
    count(*) filter (kind_no = 0) as n_email, count(*) filter (kind_no = 1) as n_ip,
    count(*) filter (kind_no = 2) as n_card, count(*) filter (kind_no = 3) as n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) filter (kind_no < {BASE_KINDS}) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) as spans,
    count(*) filter (score >= 0.8) as n_strong
  from spans group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
       coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_strong, 0) as n_strong
from d left join per using (rid)"""


@register("op6_pii", SQL)
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")

    def n(kind):
        number = KINDS.index(kind)
        return F.size(F.filter(pii, lambda s: s["kind_no"] == number)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(n(k) for k in KINDS[:BASE_KINDS]),
        F.sha2(span_text(F.filter(pii, lambda s: s["kind_no"] < BASE_KINDS)), 256).alias("base_sha256"),
        span_text(pii).alias("spans"),
        F.size(F.filter(pii, lambda s: s["score"] >= 0.8)).cast("long").alias("n_strong"))
