"""Query op12 and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.llm.phrases import ABSORBED, LONGEST, MIN_COUNT, TOP, UNKNOWN, collocations
from lumen.llm.registry import register, table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Counts of all phrases of frequent words, however they may score.
SQL = rf"""
with pieces as (select coalesce(lang, '{UNKNOWN}') as lang,
    unnest(string_split_regex({_LOWER}, '[.,;:!?\n\x0b\x0c\r]')) as piece from documents),
p as (select row_number() over () as pid, lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
o as (select pid, lang, w, unnest(range(1, len(w) + 1)) as i from p),
n as (select lang, count(*) as n from o group by lang),
c as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, count(*) as f
      from o, unnest(range(1, {LONGEST + 1})) as s(m) where i + m - 1 <= len(w)
      group by all having count(*) >= {MIN_COUNT}),
cuts as (select lang, phrase, m, f, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from c where m > 1),
scored as (
  select x.lang, x.phrase, x.m, x.f as a, l.f as l, r.f as r, k, n,
         (1000::hugeint * x.f * n // (l.f::hugeint * r.f))::bigint as score
  from cuts x join c l on l.lang = x.lang and l.phrase = array_to_string(w[:k], ' ')
  join c r on r.lang = x.lang and r.phrase = array_to_string(w[k + 1:], ' ') join n on n.lang = x.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, array_to_string(w[s:s + t - 1], ' ') as phrase, max(f) as most
           from (select lang, string_split(phrase, ' ') as w, m, f from c) x, unnest(range(1, {LONGEST + 1})) as a(s),
                unnest(range(2, {LONGEST})) as b(t) where t < m and s + t - 1 <= m group by all),
kept as (select best.* from best left join inner_ using (lang, phrase)
         where most is null or 100 * most < {ABSORBED} * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {TOP}"""


@register("op12_phrases", SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of documents in each language."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
