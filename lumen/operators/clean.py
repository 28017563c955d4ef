"""Cleaning: duplicates, gaps and type casts.

Fill values (mean, median, mode) are a single scalar per column; they are
computed by one distributed aggregate, brought back as one number and put
into the plan as a literal, so the fill itself is a narrow projection with
no join. An unknown strategy or target type leaves the frame unchanged; an
unknown column raises.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.exprs import (DATETIME_FORMATS, FLOAT_TYPES, INTEGER_PATTERN, NUMBER_PATTERN, col, finite, is_missing,
                                   number_text)
from lumen.functions.quantiles import exact_quantiles
from lumen.functions.roles import is_numeric_type
from lumen.operators.profile import value_counts


def _check(df: DataFrame, c: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == c:
            return f.dataType
    raise ValueError(f"column {c!r} not found")


def _replace(df: DataFrame, c: str, expr) -> DataFrame:
    return df.select(*[expr.alias(x) if x == c else col(x) for x in df.columns])


# --------------------------------------------------------------------- D1

def remove_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """Exact duplicate rows dropped (nulls compare equal); also returns
    how many were removed (one grouped count, no second scan of the result)."""
    from lumen.operators.profile import table_shape
    removed = table_shape(df).select("duplicate_rows").collect()[0][0]
    return df.dropDuplicates(), int(removed)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """D1 without the count."""
    return df.dropDuplicates()


# --------------------------------------------------------------------- D2-D7

def drop_missing_rows(df: DataFrame, c: str) -> DataFrame:
    """Rows missing in c dropped (NaN and +-Inf count as missing)."""
    return df.where(~is_missing(c, _check(df, c)))


def drop_column(df: DataFrame, c: str) -> DataFrame:
    """D3."""
    _check(df, c)
    return df.drop(c)


def _fill(df: DataFrame, c: str, value: Any) -> DataFrame:
    if value is None:
        return df
    dt = _check(df, c)
    return _replace(df, c, F.coalesce(F.when(~is_missing(c, dt), col(c)).cast(_widened(dt, value)), F.lit(value)))


def _widened(dt: T.DataType, value: Any) -> T.DataType:
    """The column type that holds both the column and a fill value."""
    if isinstance(value, str) or isinstance(dt, T.StringType):
        return T.StringType()
    if isinstance(value, float) and isinstance(dt, T.IntegralType):
        return dt if value.is_integer() else T.DoubleType()
    return dt


def fill_mean(df: DataFrame, c: str) -> DataFrame:
    """Numeric columns only, else unchanged. (Integer columns are widened
    to double first, as a float fill would in pandas.)"""
    dt = _check(df, c)
    if not is_numeric_type(dt):
        return df
    x = finite(col(c).cast("double"))
    mean = df.agg(F.avg(x)).collect()[0][0]
    if mean is None:
        return df
    return _replace(df, c, F.coalesce(x, F.lit(mean)))


def fill_median(df: DataFrame, c: str, approx: bool = False) -> DataFrame:
    """Numeric columns only, else unchanged."""
    dt = _check(df, c)
    if not is_numeric_type(dt):
        return df
    x = finite(col(c).cast("double"))
    med = exact_quantiles(df, [x], [0.5], approx=approx)[0][0]
    if med is None:
        return df
    return _replace(df, c, F.coalesce(x, F.lit(med)))


def fill_mode(df: DataFrame, c: str) -> DataFrame:
    """The most frequent value, smallest on ties; unchanged when all null."""
    dt = _check(df, c)
    if isinstance(dt, T.StringType):
        vc = value_counts(df, [c])
        best = vc.agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("value").alias("v")))).collect()[0][0]
        return df if best is None else _fill(df, c, best["v"])
    best = (df.where(~is_missing(c, dt)).groupBy(col(c).alias("v")).count()
            .agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("v").alias("v")))).collect()[0][0])
    return df if best is None else _fill(df, c, best["v"])


def fill_constant(df: DataFrame, c: str, value: Any) -> DataFrame:
    """No-op when the value is None."""
    return _fill(df, c, value)


# Strategy names, and what each does with a column; only D7 takes a value.
STRATEGIES = {
    "drop_rows": drop_missing_rows, "drop_column": drop_column, "mean": fill_mean, "median": fill_median, "mode": fill_mode}


def handle_missing(df: DataFrame, c: str, strategy: str, fill_value: Any = None) -> DataFrame:
    """One of the STRATEGIES or D7 by name; any other name changes nothing."""
    _check(df, c)
    if strategy == "constant":
        return fill_constant(df, c, fill_value)
    return STRATEGIES[strategy](df, c) if strategy in STRATEGIES else df


# --------------------------------------------------------------------- D8-D11

def _as_number(c: str, dt: T.DataType):
    if is_numeric_type(dt):
        return finite(col(c).cast("double"))
    if isinstance(dt, T.BooleanType):
        return col(c).cast("double")
    s = F.trim(col(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), finite(s.try_cast("double")))


def cast_int(df: DataFrame, c: str) -> DataFrame:
    """Non-numbers become null; a fractional value is an error."""
    dt = _check(df, c)
    if isinstance(dt, T.IntegralType):
        return _replace(df, c, col(c).cast("long"))
    if isinstance(dt, T.StringType):
        s = F.trim(col(c))
        x = F.when(s.rlike(INTEGER_PATTERN), s.try_cast("long"))
        frac = s.rlike(NUMBER_PATTERN) & ~s.rlike(INTEGER_PATTERN)
        num = _as_number(c, dt)
        out = (F.when(frac & (num != F.floor(num)),
                      F.raise_error(F.concat(F.lit(f"cannot cast non-integral value in {c}: "), s)))
               .when(frac, num.cast("long")).otherwise(x))
        return _replace(df, c, out.cast("long"))
    num = _as_number(c, dt)
    out = F.when(num != F.floor(num),
                 F.raise_error(F.concat(F.lit(f"cannot cast non-integral value in {c}: "),
                                        num.cast("string")))).otherwise(num.cast("long"))
    return _replace(df, c, out.cast("long"))


def cast_float(df: DataFrame, c: str) -> DataFrame:
    """Bad text becomes null (R11 guard, then R1)."""
    dt = _check(df, c)
    return _replace(df, c, _as_number(c, dt))


def cast_str(df: DataFrame, c: str) -> DataFrame:
    """To text; null stays null (rule R7)."""
    dt = _check(df, c)
    return _replace(df, c, number_text(col(c)) if isinstance(dt, FLOAT_TYPES) else col(c).cast("string"))


def cast_datetime(df: DataFrame, c: str) -> DataFrame:
    """Text in one of the known formats becomes a timestamp, else null."""
    dt = _check(df, c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _replace(df, c, col(c).cast("timestamp_ntz"))
    s = F.trim(col(c).cast("string"))
    # A format's shape (length and the places of its signs) picks it; one parse a row.
    parsed = F.lit(None).cast("timestamp_ntz")
    for fmt in reversed(DATETIME_FORMATS):
        shape = fmt.replace("'", "")
        fits = F.length(s) == len(shape)
        for at, sign in enumerate(shape):
            if sign in "-/T ":
                fits &= F.substring(s, at + 1, 1) == sign
        parsed = F.when(fits, F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")).otherwise(parsed)
    return _replace(df, c, parsed)


def cast_column(df: DataFrame, c: str, target: str) -> DataFrame:
    """Dispatch by target type; unknown targets leave the frame unchanged."""
    return {"int": cast_int, "float": cast_float, "str": cast_str,
            "datetime": cast_datetime}.get(target, lambda d, _: d)(df, c)
