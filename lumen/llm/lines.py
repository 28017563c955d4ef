"""Line dedup: lines that several documents hold stay in the first of them.

Built from DataFrame functions only:

1. Every text is split into lines; a line's key is the line without white
   space at its ends, A-Z lower-cased. Keys long enough are hashed (128 bits)
   and written with the line's document and position.
2. Documents are counted per hash, first distinct (hash, document) pairs, then
   per hash, so that a line of a third of all documents comes as one row a
   task. Hashes of enough documents remain, each with its smallest document.
3. These are joined to the written lines; a hot hash is one key of a join
   between written tables, which AQE splits. What does not lie in the hash's
   first document is gathered per text as positions to drop.
4. Texts are put together again from the positions that remain.

Texts meet the positions by document id and a hash of the text, so repeated
rows need no row numbers, and their positions are combined before the shuffle.

Defined cases: a null or empty text is one empty line; a null id counts as one
document after all others; rows with one id are one document, whose lines all
stay if it is the first; an empty table gives an empty one; long texts are
read whole; other columns are kept and may have any name but those of the
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import fresh, let, written

# What is stripped from both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "kept",
                        n_lines: str = "n_lines", n_dropped: str = "n_dropped",
                        min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text that remains, the number of lines of the whole text
    and how many of them are dropped.

    A line is dropped if its key has at least min_chars code points, at least
    min_docs documents hold it and one of them has a smaller id.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(key).alias("doc"), F.xxhash64(body).alias("content"),
                        F.posexplode(_lines(F.col(text))).alias("at", "line"))
    keyed = lines.select("doc", "content", (F.col("at") + 1).alias("place"), line_key(F.col("line")).alias("key"))
    hashed = written(spark, keyed.where(F.length("key") >= min_chars).select(
        F.unhex(F.md5("key")).alias("hash"), "doc", "content", "place"), "lines")
    holders = hashed.groupBy("hash", "doc").agg(F.lit(1).alias("one"))
    repeated = holders.groupBy("hash").agg(F.count("one").alias("docs"), F.min("doc").alias("first"))
    repeated = written(spark, repeated.where(F.col("docs") >= min_docs).select("hash", "first"), "repeated-lines")
    extra = hashed.join(repeated, "hash").where(~F.col("doc").eqNullSafe(F.col("first")))
    drops = extra.groupBy("doc", "content").agg(F.collect_set("place").alias("drops"))

    names = {c: fresh(docs, c) for c in ("content", "drops", "doc")}
    drops = drops.select(*(F.col(c).alias(n) for c, n in names.items()))
    joined = docs.join(drops, F.col(key).eqNullSafe(F.col(names["doc"])) & (F.xxhash64(body) == F.col(names["content"])), "left")
    gone = F.col(names["drops"])

    def rest(parts):
        stay = F.array_except(F.sequence(F.lit(1), F.size(parts)), gone)
        return F.array_join(F.transform(stay, lambda p: F.element_at(parts, p)), "\n")

    results = {kept: F.when(gone.isNull(), body).otherwise(let(_lines(F.col(text)), rest)),
               n_lines: F.size(_lines(F.col(text))).cast("long"),
               n_dropped: F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")}
    others = [F.col(c) for c in docs.columns if c not in results]
    return joined.select(*others, *(c.alias(n) for n, c in results.items()))
