"""Chart data as long relations.

Every chart is computed for all of its columns at once: one aggregate for the
bounds, one grouped count for the bins. Bounds are a handful of numbers per
column and travel as literals inside the plan, so no join is needed at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.exprs import as_double, col, is_missing, number_text, round_dp, sanitize  # noqa: F401  (C8 lives in exprs)
from lumen.functions.quantiles import distinct_upto, exact_quantiles, proving_rsd
from lumen.functions.roles import plot_roles
from lumen.operators.profile import correlation_values, missing_profile, value_counts

# Fixed values taken over from the reference's chart rules.
MAX_BINS = 12
MAX_COLS = 10
TOP_CATEGORIES = 7
DONUT_MAX = 5
OTHER_LABEL = "Other"
SCATTER_PAIRS = 2
SCATTER_POINTS = 150
TREND_BUCKETS = 100
DAILY_MAX_SPAN = 90
MONTHLY_MAX_SPAN = 1095
IQR_FENCE = 1.5
MISSING_CHART = ("missing_data_overview", "bar", "Missing Values by Column", "column",
                 "missing_percentage")
EMPTY_MESSAGE = "Dataset is empty."
HISTOGRAM_TITLE = "Distribution of {col}"
BOXPLOT_TITLE = "{col} Summary (Box Plot Specs)"
CATEGORY_TITLE = "Top Categories in {col}"
SCATTER_TITLE = "Relationship: {a} vs {b} (Correlation: {r})"
TREND_TITLE = "Trend of {value} over Time ({time})"


def _types(df):
    return {f.name: f.dataType for f in df.schema.fields}


def _x(df: DataFrame, name: str) -> Column:
    return as_double(name, _types(df)[name])


# --------------------------------------------------------------------- C1

def chart_missing(df: DataFrame) -> DataFrame:
    """Only the columns with at least one missing value."""
    return (missing_profile(df).where(F.col("missing_count") > 0)
            .select("column", "missing_count", F.col("missing_pct").alias("missing_percentage")))


def _binned(df: DataFrame, cols: list[tuple[Column, float, float, int]]) -> DataFrame:
    """(k, bin) rows: numpy.histogram's bin of each value on n equal bins over
    [lo, hi]. Edges are lo + i*step (last edge = hi); a bin holds
    [edge_i, edge_i+1) and the last bin also its right edge. The float guess
    is corrected against the edges exactly as numpy does. Each step is its
    own projection, so the guess is computed once per value instead of being
    re-derived inside every later expression."""
    def edge(i: Column, lo: float, hi: float, n: int) -> Column:
        return F.when(i >= n, F.lit(hi)).otherwise(i.cast("double") * F.lit((hi - lo) / n) + F.lit(lo))

    idx = range(len(cols))
    xs = df.select(*[x.alias(f"x{k}") for k, (x, _, _, _) in enumerate(cols)])
    g0 = xs.select("*", *[F.least(F.floor((F.col(f"x{k}") - F.lit(lo)) * F.lit(n / (hi - lo))).cast("int"),
                                  F.lit(n - 1)).alias(f"g{k}")
                          for k, (_, lo, hi, n) in enumerate(cols)])
    g1 = g0.select(*[f"x{k}" for k in idx],
                   *[F.when(F.col(f"x{k}") < edge(F.col(f"g{k}"), lo, hi, n), F.col(f"g{k}") - 1)
                     .otherwise(F.col(f"g{k}")).alias(f"h{k}") for k, (_, lo, hi, n) in enumerate(cols)])
    g2 = g1.select(*[f"x{k}" for k in idx],
                   *[F.when((F.col(f"x{k}") >= edge(F.col(f"h{k}") + 1, lo, hi, n)) & (F.col(f"h{k}") != n - 1),
                            F.col(f"h{k}") + 1).otherwise(F.col(f"h{k}")).alias(f"b{k}")
                     for k, (_, lo, hi, n) in enumerate(cols)])
    structs = [F.when(F.col(f"x{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("bin")))
               for k in idx]
    return g2.select(F.explode(F.array(*structs)).alias("e")).where(F.col("e").isNotNull()).select("e.*")


# --------------------------------------------------------------------- C2 / C3 shared

def numeric_bounds(df: DataFrame, cols: list[str]) -> list[dict]:
    """count/min/max and min(distinct, 12) per column (1-2 small jobs)."""
    xs = [_x(df, c) for c in cols]
    if not xs:
        return []
    aggs = []
    rsd = proving_rsd(MAX_BINS)
    for i, x in enumerate(xs):
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                 F.approx_count_distinct(x, rsd).alias(f"e{i}")]
    row = df.agg(*aggs).collect()[0]
    bounds = [dict(column=c, n=row[f"n{i}"], lo=row[f"a{i}"], hi=row[f"b{i}"], est=row[f"e{i}"])
              for i, c in enumerate(cols)]
    # A column with min == max has one distinct value; only the rest need counting.
    varied = [i for i, b in enumerate(bounds) if b["n"] and b["lo"] < b["hi"]]
    caps = distinct_upto(df, [xs[i] for i in varied], MAX_BINS,
                         estimates=[bounds[i]["est"] for i in varied])
    for b in bounds:
        b["distinct"] = 1 if b["n"] else 0
    for i, d in zip(varied, caps):
        bounds[i]["distinct"] = d
    return bounds


# --------------------------------------------------------------------- C2

def chart_histogram(df: DataFrame, include: list[str] | None = None,
                    max_cols: int = MAX_COLS) -> DataFrame:
    """Equal-width bins, count = min(12, distinct); zero bins kept;
    columns with <= 1 distinct value skipped; label ``lo - hi`` at 2 dp."""
    spark = df.sparkSession
    schema = "column string, bin int, range string, count long"
    cols = plot_roles(df, include).numeric[:max_cols]
    bounds = [b for b in numeric_bounds(df, cols) if b["distinct"] > 1]
    if not bounds:
        return spark.createDataFrame([], schema)
    for b in bounds:
        b["bins"] = min(MAX_BINS, b["distinct"])
    counts = (_binned(df, [(_x(df, b["column"]), b["lo"], b["hi"], b["bins"]) for b in bounds])
              .groupBy("k", "bin").agg(F.count(F.lit(1)).alias("count")))
    # All bins of all charted columns: at most 12 per column, built on the driver.
    grid_rows = []
    for k, b in enumerate(bounds):
        nb, lo, hi = b["bins"], b["lo"], b["hi"]
        step = (hi - lo) / nb
        edges = [i * step + lo for i in range(nb)] + [hi]
        for i in range(nb):
            grid_rows.append((k, b["column"], i, float(edges[i]), float(edges[i + 1])))
    grid = spark.createDataFrame(grid_rows, "k int, column string, bin int, e0 double, e1 double")
    label = F.concat(number_text(round_dp("e0", 2)), F.lit(" - "), number_text(round_dp("e1", 2)))
    return (F.broadcast(grid).join(counts, ["k", "bin"], "left")
            .select("column", "bin", label.alias("range"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# --------------------------------------------------------------------- C3

def chart_boxplot(df: DataFrame, include: list[str] | None = None,
                  max_cols: int = MAX_COLS, approx: bool = False) -> DataFrame:
    """Min, q1, median, q3 (2 dp), max and the count of values outside
    1.5 IQR from the unrounded quartiles; same skip rule as C2."""
    spark = df.sparkSession
    schema = ("column string, min double, q1 double, median double, q3 double, "
              "max double, outliers_count long")
    cols = plot_roles(df, include).numeric[:max_cols]
    bounds = [b for b in numeric_bounds(df, cols) if b["distinct"] > 1]
    if not bounds:
        return spark.createDataFrame([], schema)
    xs = [_x(df, b["column"]) for b in bounds]
    stats = [(b["n"], b["lo"], b["hi"]) for b in bounds]
    qs = exact_quantiles(df, xs, [0.25, 0.5, 0.75], stats=stats, approx=approx)
    aggs = []
    for k, (x, q) in enumerate(zip(xs, qs)):
        iqr = q[2] - q[0]
        low, high = q[0] - IQR_FENCE * iqr, q[2] + IQR_FENCE * iqr
        aggs.append(F.count_if((x < F.lit(low)) | (x > F.lit(high))).alias(f"o{k}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(b["column"]).alias("column"), F.lit(b["lo"]).alias("min"),
                        round_dp(F.lit(q[0]), 2).alias("q1"), round_dp(F.lit(q[1]), 2).alias("median"),
                        round_dp(F.lit(q[2]), 2).alias("q3"), F.lit(b["hi"]).alias("max"),
                        F.col(f"o{k}").cast("long").alias("outliers_count"))
               for k, (b, q) in enumerate(zip(bounds, qs))]
    return row.select(F.inline(F.array(*structs)))


# --------------------------------------------------------------------- C4

def chart_categories(df: DataFrame, include: list[str] | None = None,
                     max_cols: int = MAX_COLS, k: int = TOP_CATEGORIES) -> DataFrame:
    """C4: the top k categories (count desc, value asc) plus ``Other`` for the
    rest; donut when at most 5 categories are shown, else bar. A real value
    called ``Other`` stays a separate row (it carries its own rank)."""
    spark = df.sparkSession
    schema = "column string, rank int, category string, count long, chart_type string"
    cols = plot_roles(df, include).categorical[:max_cols]
    if not cols:
        return spark.createDataFrame([], schema)
    vc = value_counts(df, cols)
    w = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"))
    top = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # Totals per column come from the same grouped counts (exchange is reused).
    per = vc.groupBy("position").agg(F.count(F.lit(1)).alias("distinct"),
                                     F.sum("count").alias("total"))
    shown = F.least(F.col("distinct"), F.lit(k))
    kind = F.when(shown <= DONUT_MAX, "donut").otherwise("bar")
    top_rows = top.join(per, "position").select(
        "column", F.col("rank").cast("int"), F.col("value").alias("category"),
        F.col("count").cast("long"), kind.alias("chart_type"))
    top_sum = top.groupBy("position").agg(F.sum("count").alias("shown_total"))
    other = (per.where(F.col("distinct") > k).join(top_sum, "position")
             .join(vc.select("position", "column").dropDuplicates(["position"]), "position")
             .select("column", F.lit(k + 1).cast("int").alias("rank"),
                     F.lit(OTHER_LABEL).alias("category"),
                     (F.col("total") - F.col("shown_total")).cast("long").alias("count"),
                     kind.alias("chart_type")))
    return top_rows.unionByName(other)


# --------------------------------------------------------------------- C5

def ranked_pairs(df: DataFrame, cols: list[str]) -> list[tuple[str, str, float, float]]:
    """Pairs by |r| descending (null r counts as 0); ties keep column order."""
    r = correlation_values(df, cols, diagonal=False)
    pairs = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            v = r[(i, j)]
            pairs.append((cols[i], cols[j], abs(v) if v is not None else 0.0, v))
    return sorted(pairs, key=lambda p: -p[2])


def chart_scatter(df: DataFrame, order_by: list[str], include: list[str] | None = None,
                  pairs: int = SCATTER_PAIRS, n: int = SCATTER_POINTS) -> DataFrame:
    """The first n complete rows (key order) of the best correlated pairs."""
    spark = df.sparkSession
    cols = plot_roles(df, include).numeric
    keyed = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(
        f for k in order_by for f in df.schema.fields if f.name == k))
    schema = f"pair int, x_col string, y_col string, score double, {keyed}, x double, y double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    best = ranked_pairs(df, cols)[:pairs]
    parts = []
    for p, (a, b, score, _) in enumerate(best):
        xa, xb = _x(df, a), _x(df, b)
        keys = [col(k).alias(f"k{i}") for i, k in enumerate(order_by)]
        # TakeOrderedAndProject: every task keeps its n first rows only; the
        # key columns stay in the result to give the points their order.
        first = (df.select(*keys, xa.alias("x"), xb.alias("y"))
                 .where(F.col("x").isNotNull() & F.col("y").isNotNull())
                 .orderBy(*[F.col(f"k{i}") for i in range(len(order_by))]).limit(n))
        parts.append(first.select(
            F.lit(p).alias("pair"), F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
            round_dp(F.lit(score), 2).alias("score"),
            *[F.col(f"k{i}") for i in range(len(order_by))], "x", "y"))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


# --------------------------------------------------------------------- C6

def trend_grain(span_days: int) -> str:
    if span_days <= DAILY_MAX_SPAN:
        return "day"
    if span_days <= MONTHLY_MAX_SPAN:
        return "month"
    return "year"


def chart_trend(df: DataFrame, time_col: str | None = None, value_col: str | None = None,
                include: list[str] | None = None) -> DataFrame:
    """Mean of the first numeric column over the first temporal column.

    Span (whole days between first and last time) picks the grain: <= 90 days
    daily, <= 1095 month-end, else year-end. Only the first 100 calendar
    buckets count (empty ones included); empty buckets are then dropped."""
    spark = df.sparkSession
    schema = "date string, value double"
    roles = plot_roles(df, include)
    time_col = time_col or (roles.temporal[0] if roles.temporal else None)
    value_col = value_col or (roles.numeric[0] if roles.numeric else None)
    if not time_col or not value_col:
        return spark.createDataFrame([], schema)
    t = col(time_col).cast("timestamp_ntz")
    v = _x(df, value_col)
    pts = df.select(t.alias("t"), v.alias("v")).where(F.col("t").isNotNull() & F.col("v").isNotNull())
    row = pts.agg(F.min("t").alias("a"), F.max("t").alias("b"),
                  F.expr("timestampdiff(DAY, min(t), max(t))").alias("span")).collect()[0]
    if row["a"] is None:
        return spark.createDataFrame([], schema)
    grain = trend_grain(row["span"])
    first = F.lit(row["a"]).cast("timestamp_ntz")
    if grain == "day":
        bucket = F.to_date("t")
        index = F.datediff(bucket, F.to_date(first))
    elif grain == "month":
        bucket = F.last_day(F.to_date("t"))
        index = ((F.year("t") - F.year(first)) * 12 + F.month("t") - F.month(first))
    else:
        bucket = F.make_date(F.year("t"), F.lit(12), F.lit(31))
        index = F.year("t") - F.year(first)
    # The bucket index is known per row, so the 100-bucket cut is a filter
    # that runs before the aggregate.
    return (pts.where(index < TREND_BUCKETS)
            .groupBy(bucket.alias("d")).agg(F.avg("v").alias("m"))
            .select(F.date_format("d", "yyyy-MM-dd").alias("date"),
                    round_dp("m", 2).alias("value")))


# --------------------------------------------------------------------- C7

def _facts_of_charts(df: DataFrame, roles, shown: list[str], max_cols: int) -> dict:
    """Rows, gaps and what decides on each chart, from one aggregate; a second
    job counts the values of those categories of which a sketch cannot say
    that they have more than DONUT_MAX."""
    types = _types(df)
    numbers, cats = roles.numeric[:max_cols], roles.categorical[:max_cols]
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.max(F.greatest(*(is_missing(c, types[c]).cast("int") for c in shown), F.lit(0))), F.lit(0)).alias("gaps")]
    for i, c in enumerate(numbers):
        aggs += [F.min(_x(df, c)).alias(f"lo{i}"), F.max(_x(df, c)).alias(f"hi{i}")]
    rsd = proving_rsd(DONUT_MAX)
    for i, c in enumerate(cats):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.approx_count_distinct(col(c).cast("string"), rsd).alias(f"e{i}")]
    if roles.temporal and roles.numeric:
        both = col(roles.temporal[0]).isNotNull() & _x(df, roles.numeric[0]).isNotNull()
        aggs.append(F.count_if(both).alias("trend"))
    row = df.agg(*aggs).first().asDict()
    present = [i for i, _ in enumerate(cats) if row[f"n{i}"]]
    counts = distinct_upto(df, [col(cats[i]).cast("string") for i in present], DONUT_MAX + 1,
                           estimates=[row[f"e{i}"] if row[f"e{i}"] > DONUT_MAX + 1 else 0 for i in present])
    return {"rows": row["rows"], "gaps": row["gaps"] > 0, "trend": row.get("trend", 0) > 0,
            "varied": [c for i, c in enumerate(numbers) if row[f"lo{i}"] is not None and row[f"lo{i}"] < row[f"hi{i}"]],
            "categories": [(cats[i], "donut" if n <= DONUT_MAX else "bar") for i, n in zip(present, counts)]}


def _listed(df: DataFrame, include: list[str] | None, max_cols: int) -> tuple[dict, list[tuple[str, str, str]]]:
    """Those facts, and (chart_id, chart_type, title) of each chart in order."""
    roles = plot_roles(df, include)
    shown = [c for c in include or [] if c in df.columns] or df.columns
    facts = _facts_of_charts(df, roles, shown, max_cols)
    charts: list[tuple[str, str, str]] = [MISSING_CHART[:3]] if facts["gaps"] else []
    for c in facts["varied"]:
        charts.append((f"hist_{c}", "histogram", HISTOGRAM_TITLE.format(col=c)))
        charts.append((f"boxplot_{c}", "boxplot", BOXPLOT_TITLE.format(col=c)))
    charts += [(f"cat_{c}", kind, CATEGORY_TITLE.format(col=c)) for c, kind in facts["categories"]]
    if facts["rows"] and len(roles.numeric) >= 2:
        for a, b, score, _ in ranked_pairs(df, roles.numeric)[:SCATTER_PAIRS]:
            charts.append((f"scatter_{a}_vs_{b}", "scatter", SCATTER_TITLE.format(a=a, b=b, r=round(score, 2))))
    if facts["trend"]:
        t, v = roles.temporal[0], roles.numeric[0]
        charts.append((f"line_trend_{t}", "line", TREND_TITLE.format(value=v, time=t)))
    return facts, charts if facts["rows"] else []


def chart_catalog(df: DataFrame, order_by: list[str] | None = None,
                  include: list[str] | None = None, max_cols: int = MAX_COLS) -> DataFrame:
    """The list of charts the data supports, in the reference's order:
    missing, histogram + box per numeric column, categories, scatter, trend.
    Three jobs at most: all facts, small categories, correlations."""
    schema = "seq int, chart_id string, chart_type string, title string"
    charts = _listed(df, include, max_cols)[1] if df.columns else []
    return df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(charts)], schema)


def chart_summary(df: DataFrame, include: list[str] | None = None) -> DataFrame:
    """C7 totals: charts, numeric, categorical, datetime, has_missing; an
    empty table gives zero charts and a message."""
    schema = ("total_charts long, numeric_features long, categorical_features long, "
              "datetime_features long, has_missing_data boolean, message string")
    facts, charts = _listed(df, include, MAX_COLS) if df.columns else ({"rows": 0}, [])
    if not facts["rows"]:
        return df.sparkSession.createDataFrame([(0, None, None, None, None, EMPTY_MESSAGE)], schema)
    roles = plot_roles(df, include)
    return df.sparkSession.createDataFrame(
        [(len(charts), len(roles.numeric), len(roles.categorical), len(roles.temporal), facts["gaps"], None)], schema)


BOX_PARTS = ("min", "q1", "median", "q3", "max", "outliers_count")


def chart_payload(df: DataFrame, order_by: list[str], include: list[str] | None = None) -> DataFrame:
    """C7 whole: the points of every chart of the catalog in one relation
    (chart_id, point, label, x, y). Bars, bins and lines have a label and y,
    scatter points x and y; box plots have one point for each of BOX_PARTS.
    Points count from 0 in the order in which they are drawn."""
    spark = df.sparkSession
    none = F.lit(None).cast("double").alias("x")
    rows: list[DataFrame] = []

    def add(part: DataFrame, chart_id: Column, point: Column, label: Column, x: Column, y: Column) -> None:
        rows.append(part.select(chart_id.cast("string").alias("chart_id"), point.cast("int").alias("point"),
                                label.cast("string").alias("label"), x, y.cast("double").alias("y")))

    if df.columns:
        shown = [c for c in include or [] if c in df.columns] or df.columns
        gaps = missing_profile(df.select(*(col(c) for c in shown))).where("missing_count > 0")
        add(gaps, F.lit(MISSING_CHART[0]), F.row_number().over(Window.orderBy("position")) - 1, F.col("column"), none, F.col("missing_pct"))
        add(chart_histogram(df, include), F.concat(F.lit("hist_"), "column"), F.col("bin"), F.col("range"), none, F.col("count"))
        box = chart_boxplot(df, include).select("column", F.posexplode(F.array(*(
            F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("value")) for p in BOX_PARTS))).alias("k", "e"))
        add(box, F.concat(F.lit("boxplot_"), "column"), F.col("k"), F.col("e.part"), none, F.col("e.value"))
        add(chart_categories(df, include), F.concat(F.lit("cat_"), "column"), F.col("rank") - 1, F.col("category"), none, F.col("count"))
        scatter = chart_scatter(df, order_by, include)
        keys = [f"k{i}" for i in range(len(order_by))]
        place = F.row_number().over(Window.partitionBy("pair").orderBy(*keys)) - 1  # SCATTER_POINTS rows
        add(scatter, F.concat(F.lit("scatter_"), "x_col", F.lit("_vs_"), "y_col"), place, F.lit(None), F.col("x"), F.col("y"))
        roles = plot_roles(df, include)
        if roles.temporal and roles.numeric:
            place = F.row_number().over(Window.orderBy("date")) - 1  # TREND_BUCKETS rows at most
            add(chart_trend(df, include=include), F.lit(f"line_trend_{roles.temporal[0]}"), place, F.col("date"), none, F.col("value"))
    if not rows:
        return spark.createDataFrame([], "chart_id string, point int, label string, x double, y double")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
