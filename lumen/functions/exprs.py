"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that pandas' CSV reader treats as missing (rule R2).
MISSING_TOKENS = ("", "NA", "N/A", "null", "None", "nan", "NaN", "NULL", "#N/A",
                  "n/a", "-NaN", "-nan", "<NA>", "#N/A N/A", "#NA", "-1.#IND",
                  "-1.#QNAN", "1.#IND", "1.#QNAN")

# Rule R11: only text that looks like a number may be cast to a number
# (Spark accepts '1d' and '2f', pandas does not).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL_FLOAT_PATTERN = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
BOOLEAN_PATTERN = r"(?i)^(true|false)$"

# Rule R11: datetime text formats tried in order; anything else becomes null.
DATETIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
                    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")

FLOAT_TYPES = (T.FloatType, T.DoubleType)


def finite(c: Column) -> Column:
    """NaN and +-Inf are missing."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def is_missing(name: str, dt: T.DataType) -> Column:
    """R1 for any column: null, and NaN or +-Inf in a float column."""
    c = col(name)
    if isinstance(dt, FLOAT_TYPES):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return c.isNull()


def number_text(c: Column) -> Column:
    """A float as Python prints it: plain decimals from 1e-4 to below 1e16,
    else an exponent of at least two digits. (Spark's own text has an exponent
    from 1e7 on.)"""
    s = c.cast("string")
    plain = F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.concat(
        F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", ""), F.lit("e"),
        F.when(F.contains(s, F.lit("E-")), "-").otherwise("+"),
        F.regexp_replace(F.regexp_extract(s, r"(\d+)$", 1), r"^(\d)$", "0$1"))
    size = F.abs(c)
    return (F.when(~F.contains(s, F.lit("E")) & ((size >= 1e-4) | (size == 0)), s)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .when(F.contains(s, F.lit("E")), power).otherwise(s))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and +-Inf to null in every float column; other columns untouched."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            out.append(finite(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def col(name: str) -> Column:
    """A column reference that survives dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(name: str, dt: T.DataType) -> Column:
    c = col(name)
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    return finite(c.cast("double"))


def fmt2(c: Column) -> Column:
    """Python ``f"{x:,.2f}"`` after half-up rounding (rule R5)."""
    return F.format_number(round_dp(c, 2), 2)


def round_dp(c, d: int) -> Column:
    """Round half away from zero on the scaled binary value (x * 10^d).

    Spark's ``round`` rounds the shortest decimal text of the double
    (9588.085 -> 9588.09) while the binary value is below the tie; scaling
    first agrees with DuckDB's ``round`` and, in more cases, with Python's
    (rule R5)."""
    c = F.col(c) if isinstance(c, str) else c
    p = float(10 ** d)
    return F.round(c * F.lit(p)) / F.lit(p)
