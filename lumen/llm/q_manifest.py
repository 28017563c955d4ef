"""Query op13 and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.manifest import FAN, folded, digest, leaf, manifest, siblings
from lumen.llm.registry import register, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The SQL has a fixed number of levels, of leaves and of subroots; a level
# where a group has one node changes nothing.
LEVELS, TOP_LEVELS = 10, 4


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _tree(name: str, levels: int) -> str:
    """CTEs: nodes of each level (g, i, n, h) and their runs (g, up, hs)."""
    out = []
    for k in range(levels):
        out.append(f"""{name}run{k} as (select g, i // {FAN} as up, any_value(n) as n, list(h order by i) as hs
  from {name}{k} group by g, i // {FAN})""")
        out.append(f"""{name}{k + 1} as (select g, up as i, (n + {FAN - 1}) // {FAN} as n,
  case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}run{k})""")
    return ",\n".join(out)


def _climb(name: str, start: str, levels: int) -> str:
    """CTEs that fold f and gather the proof p of rows with (g, i) upwards."""
    out, before = [], start
    for k in range(levels):
        size = FAN ** k
        at = f"((x.i // {size}) % {FAN})::int"
        left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
        out.append(f"""{name}up{k} as (select x.* exclude (f, p),
  case when n > 1 then sha256({left} || f || {right}) else f end as f,
  case when n > 1 then p || {left} || {right} else p end as p
  from {before} x join {name}run{k} r on x.g = r.g and x.i // {size * FAN} = r.up)""")
        before = f"{name}up{k}"
    return ",\n".join(out)


SQL = f"""
with c as (select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
    string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, s: case when s >= 0 then xor(a, s) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) as crc
  from documents),
t as (select *, case when crc % 3 = 0 then translate(text, '{_UPPER}', '{_LOWER}') else text end as other from c),
leaves as (select doc_id, coalesce('+' || lang, '') as g,
  sha256({' || '.join(_field(c) for c in FIELDS)}) as h,
  sha256({' || '.join(_field(c) for c in FIELDS[:-1])} || {_field('other')}) as f from t),
a as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, '' as p from leaves),
l0 as (select g, i, count(*) over (partition by g) as n, h from a),
{_tree('l', LEVELS)},
s as (select g as lang_key, h as subroot, row_number() over (order by g) - 1 as si from l{LEVELS} where i = 0),
t0 as (select 'all' as g, si as i, count(*) over () as n, subroot as h from s),
{_tree('t', TOP_LEVELS)},
{_climb('l', 'a', LEVELS)},
b as (select u.* exclude (g, i), 'all' as g, si as i, subroot from lup{LEVELS - 1} u join s on u.g = s.lang_key),
{_climb('t', 'b', TOP_LEVELS)}
select doc_id, u.h as leaf, subroot, r.h as root, sha256(p) as proof_sha256, f as folded_root, f = r.h as verified
from tup{TOP_LEVELS - 1} u, t{TOP_LEVELS} r"""


def tampered(key: Column, text: Column) -> Column:
    """text as a tampered row has it: A-Z lower-cased where 3 divides the
    checksum of the key."""
    hit = F.coalesce(F.crc32(key.cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


@register("op13_manifest", SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of documents, each row checked against it."""
    docs = table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf(*cols).alias("leaf"),
                         leaf(*cols[:-1], tampered(F.col("doc_id"), F.col("text"))).alias("seen"))
    found = manifest(leaves).withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
