"""Column roles (schema rules, no Spark job of their own).

F1 column_roles   numeric (not bool) / temporal / else categorical
F2 plot_roles     F1 minus identifier columns; bool is categorical
F4 feature_columns all but target and identifiers
F5 find_target    first known label name, else the last column
F6 risk_features  drop id-like and customer-like names
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values that must equal the reference's behaviour: what names a column
# of keys, and what names one that says nothing about risk.
IDENTIFIER = re.compile(r"\s*(?:id|index|uuid|unnamed: 0|.*_id)\s*", re.IGNORECASE | re.DOTALL)
NO_RISK_FEATURE = re.compile(r"id|customer", re.IGNORECASE)
TARGET_NAMES = ("churn", "churned", "exited", "target")


@dataclass
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    temporal: list[str] = field(default_factory=list)


def is_numeric_type(dt: T.DataType) -> bool:
    # BooleanType is not a NumericType in Spark, matching the "not bool" rule.
    return isinstance(dt, T.NumericType)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_identifier(name: str) -> bool:
    return IDENTIFIER.fullmatch(name or "") is not None


def column_roles(df: DataFrame) -> Roles:
    """every column gets a role, identifiers included."""
    r = Roles()
    for f in df.schema.fields:
        if is_temporal_type(f.dataType):
            r.temporal.append(f.name)
        elif is_numeric_type(f.dataType):
            r.numeric.append(f.name)
        else:
            r.categorical.append(f.name)
    return r


def plot_roles(df: DataFrame, include: list[str] | None = None) -> Roles:
    """as F1 restricted to ``include`` (when any is known) less identifiers.

    Identifiers get no role at all (the reference would send a numeric
    ``*_id`` column to its date guesser; that meaningless trend is not kept).
    """
    cols = df.columns
    if include:
        known = [c for c in include if c in cols]
        if known:
            cols = known
    types = {f.name: f.dataType for f in df.schema.fields}
    r = Roles()
    for c in cols:
        if is_identifier(c):
            continue
        dt = types[c]
        if is_numeric_type(dt):
            r.numeric.append(c)
        elif is_temporal_type(dt):
            r.temporal.append(c)
        elif isinstance(dt, (T.StringType, T.BooleanType)):
            r.categorical.append(c)
    return r


def feature_columns(df: DataFrame, target: str) -> list[str]:
    """all columns but the target and identifiers."""
    return [c for c in df.columns if c != target and not is_identifier(c)]


def find_target(df: DataFrame) -> str:
    """the first known label name present, else the last column."""
    known = {name: place for place, name in enumerate(TARGET_NAMES)}
    return min(reversed(df.columns), key=lambda c: known.get(c, len(known)))


def risk_features(df: DataFrame, target: str) -> list[str]:
    """the columns but the target whose names hold neither ``id`` (so not
    ``paid`` either) nor ``customer``."""
    return [c for c in df.columns if c != target and not NO_RISK_FEATURE.search(c)]
