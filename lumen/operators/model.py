"""Modelling on Spark ML (M1-M11) and model-based risk.

Forests cannot match another library bit for bit, so these operators are
checked by properties (importances sum to 1, scores in [0, 1], AUC above
chance, a saved model predicts the same) plus SQL-checkable pieces: task
detection, label codes, exact median imputation, split shares, accuracy,
R2 and feature coercion.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.exprs import FLOAT_TYPES, NUMBER_PATTERN, col, finite
from lumen.functions.quantiles import distinct_upto, exact_quantiles
from lumen.functions.ranks import roc_auc, sums_before
from lumen.functions.roles import feature_columns, is_numeric_type
from lumen.operators.profile import value_counts
from lumen.session import tasks_for, written

# Fixed values from the reference's training code.
SEED = 42
SERVICE_TREES = 50
CHURN_TREES = 100
CHURN_DEPTH = 10
SERVICE_DEPTH = 10          # the reference grows trees without a depth limit; Spark needs one
TEST_SHARE = 0.2
SMALL_TEST_SHARE = 0.4      # library rule for tables of at most 10 rows
DISTINCT_CAP = 11           # more than the service rule's classes
SERVICE_CLASS_MAX = 10      # service rule: <= 10 distinct target values is classification
MISSING_CATEGORY = "nan"    # R7: missing text gets its own code instead of dropping the row
HASH_BUCKETS = 2 ** 16      # of the hash space, for the ranks of the stratified split
HASH_SPACE = 2 ** 52        # hash values kept exactly representable as doubles


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


# --------------------------------------------------------------------- M1

def detect_task(df: DataFrame, columns: list[str] | None = None, upto: int | None = None) -> DataFrame:
    """M1 for every candidate target: (column, n_distinct, library_task,
    service_task). Library: numeric with > 2 distinct values is regression.
    Service: text or <= 10 distinct values is classification. Nulls are
    dropped first. Exact distinct counts come from one grouped count; ``upto``
    stops them there (DISTINCT_CAP is all the rules ask), and then only columns
    with few values are grouped at all."""
    types = _types(df)
    cols = columns or [c for c in df.columns if c in types]
    if upto is None:
        found = {r["column"]: r["d"] for r in value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
        counts = [found.get(c, 0) for c in cols]
    else:
        values = [(finite(col(c)) + 0.0 if isinstance(types[c], FLOAT_TYPES) else col(c)).cast("string") for c in cols]
        counts = distinct_upto(df, values, upto)
    rows = []
    for c, d in zip(cols, counts):
        library = "regression" if is_numeric_type(types[c]) and d > 2 else "classification"
        service = "classification" if isinstance(types[c], T.StringType) or d <= SERVICE_CLASS_MAX else "regression"
        rows.append((c, d, library, service))
    return df.sparkSession.createDataFrame(rows, "column string, n_distinct long, library_task string, service_task string")


def task_for(df: DataFrame, target: str, rule: str = "service") -> str:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    row = detect_task(df, [target], upto=DISTINCT_CAP).collect()[0]
    return row["service_task"] if rule == "service" else row["library_task"]


# --------------------------------------------------------------------- M3 / M4

def label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """M3 as a relation: (column, value, code) with alphabetical codes from 0;
    missing text is a value of its own, as in ``encode_labels``.

    A code is the number of distinct values before it. These are sorted by
    ranges over all tasks (``sums_before``), never in one."""
    filled = df.select(*[F.coalesce(col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c) for c in cols])
    values = value_counts(filled, cols).select("position", "column", "value", F.lit(1).alias("one"))
    ranked = sums_before(values, ["position", "column"], ["value"], ["one"])
    return ranked.select("column", "value", F.col("one_before").cast("int").alias("code"))


def spare_codes(codes: DataFrame) -> dict[str, int]:
    """The code after the last of each column: for values without one. One row
    for each column comes to the driver."""
    return {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def attach_codes(df: DataFrame, cols: list[str], codes: DataFrame, spare: dict[str, int]) -> DataFrame:
    """df with ``<c>__code`` (double) for each text column c, by one join a
    column: Spark broadcasts a vocabulary only where it is small, and AQE
    splits the rows of a hot value."""
    for c in cols:
        own = codes.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        df = df.join(own, F.coalesce(col(c).cast("string"), F.lit(MISSING_CATEGORY)) == F.col("__value"), "left").withColumn(
            f"{c}__code", F.coalesce(F.col("__code"), F.lit(spare.get(c, 0))).cast("double")).drop("__value", "__code")
    return df


def encode_labels(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """M3 applied: each text column replaced by its code (missing -> 'nan'),
    and the codes."""
    codes = written(df.sparkSession, label_codes(df, cols), "codes")
    coded = attach_codes(df, cols, codes, spare_codes(codes))
    return coded.select(*[col(f"{c}__code").cast("int").alias(c) if c in cols else col(c) for c in df.columns]), codes


def impute_median(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """M4: numeric features filled with their exact median (``Imputer`` is
    approximate); the medians are scalars placed in the plan as literals."""
    xs = [finite(col(c).cast("double")) for c in cols]
    meds = exact_quantiles(df, xs, [0.5], approx=approx)
    fill = {c: m[0] for c, m in zip(cols, meds)}
    return df.select(*[F.coalesce(finite(col(c).cast("double")), F.lit(fill[c])).alias(c)
                       if c in fill and fill[c] is not None else col(c) for c in df.columns])


# --------------------------------------------------------------------- M5 / M6

def _unit_hash(key: Column, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(HASH_SPACE)).cast("double")


def split(df: DataFrame, key: str, test_share: float | None = None,
          seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """M5: a stable split by hash of the key (independent of partitioning):
    80/20, or 60/40 for tables of at most 10 rows (library rule)."""
    if test_share is None:
        small = df.limit(11).count() <= 10
        test_share = SMALL_TEST_SHARE if small else TEST_SHARE
    h = _unit_hash(col(key), seed) / float(HASH_SPACE)
    return df.where(h >= test_share), df.where(h < test_share)


def stratified_split(df: DataFrame, label: str, key: str, train_share: float = 1 - TEST_SHARE,
                     seed: int = SEED) -> DataFrame:
    """M6: adds ``is_train`` keeping each class's share exactly: a row is
    train when its hash rank in its class r satisfies r <= train_share*(n-1)
    (percent_rank <= share). The threshold of each class comes from grouped
    counts of hash buckets and a sort of the one bucket that holds the rank,
    so neither the number of classes nor the size of one is bounded."""
    h = _unit_hash(col(key), seed)
    hashed = df.select(col(label).alias("__c"), h.alias("__h"),
                       F.floor(h / float(HASH_SPACE // HASH_BUCKETS)).alias("__b"))
    counts = hashed.groupBy("__c", "__b").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("__c")
    upto = F.sum("n").over(by_class.orderBy("__b"))
    rank = F.floor(F.lit(train_share) * (F.sum("n").over(by_class) - 1))
    edge = (counts.select("__c", "__b", (upto - F.col("n")).alias("below"), upto.alias("upto"), rank.alias("rank"))
            .where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
            .select(F.col("__c").alias("c"), F.col("__b").alias("b"), (F.col("rank") - F.col("below") + 1).alias("k")))
    place = F.row_number().over(Window.partitionBy("c").orderBy("__h"))
    limits = (hashed.join(edge, F.col("__c").eqNullSafe(F.col("c")) & (F.col("__b") == F.col("b")))
              .withColumn("place", place).where(F.col("place") == F.col("k"))
              .select(F.col("c").alias("__class"), F.col("__h").alias("__limit")))
    return (df.join(limits, col(label).eqNullSafe(F.col("__class")), "left")
            .withColumn("is_train", F.coalesce(h <= F.col("__limit"), F.lit(False))).drop("__class", "__limit"))


def split_shares(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows per (class, part) after the stratified split."""
    s = stratified_split(df, label, key)
    return (s.groupBy(col(label).alias("label"),
                      F.when(F.col("is_train"), "train").otherwise("test").alias("part"))
            .agg(F.count(F.lit(1)).alias("rows")))


# --------------------------------------------------------------------- M7-M10

@dataclass
class Trained:
    model: PipelineModel
    task: str
    target: str
    features: list[str]
    numeric: list[str]
    text: list[str]
    medians: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    spare: dict = field(default_factory=dict)
    codes: DataFrame | None = None      # of the text features
    data: DataFrame | None = None       # the prepared rows, of the session that fitted only


NOT_IN_BUNDLE = ("model", "codes", "data")


def _narrow(df: DataFrame, target: str, numeric: list[str], text: list[str], extra: list[str]) -> DataFrame:
    return df.select(
        *[finite(col(c).cast("double")).alias(c) for c in numeric],
        *[F.coalesce(col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c) for c in text],
        col(target).alias(target), *[col(c) for c in extra if c not in numeric + text])


def _filled(data: DataFrame, medians: dict) -> DataFrame:
    return data.withColumns({c: F.coalesce(col(c), F.lit(m)) for c, m in medians.items()})


def prepare_features(df: DataFrame, trained: Trained, keep: list[str] | None = None) -> DataFrame:
    """Rows in the shape the fitted pipeline expects (training medians and
    codes reused)."""
    data = _narrow(df, trained.target, trained.numeric, trained.text, keep or [])
    return _filled(attach_codes(data, trained.text, trained.codes, trained.spare), trained.medians)


def fit_model(df: DataFrame, target: str, task: str | None = None, features: list[str] | None = None,
              key: str | None = None, trees: int = SERVICE_TREES, depth: int = SERVICE_DEPTH,
              stratify: bool = False, seed: int = SEED, rule: str = "service") -> tuple[Trained, DataFrame]:
    """M7/M8/M9: pipeline (codes for text, assembler, forest), fitted on the
    train part; returns the model and the scored test part.

    rule "service": the service's task rule and 20 % to test; rule "library":
    the library's task rule, and 40 % to test for tables of at most 10 rows."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    df = df.where(col(target).isNotNull())
    task = task or task_for(df, target, rule)
    features = features or feature_columns(df, target)
    types = _types(df)
    numeric = [c for c in features if is_numeric_type(types[c]) or isinstance(types[c], T.BooleanType)]
    text = [c for c in features if c not in numeric]
    spark = df.sparkSession
    # The input is read once; all that follows reads these narrow tables.
    data = written(spark, _narrow(df, target, numeric, text, [key] if key and key != target else []), "features")
    tasks = tasks_for(data)
    codes, spare = None, {}
    if text:
        codes = written(spark, label_codes(data, text), "codes")
        spare = spare_codes(codes)
        data = attach_codes(data, text, codes, spare)
    # Narrow rows are few bytes, but a forest works long on each: they are
    # spread over all cores, for the fit as for scoring.
    data = written(spark, data.repartition(tasks), "spread")
    meds = exact_quantiles(data, [col(c) for c in numeric], [0.5])
    medians = {c: (m[0] if m[0] is not None else 0.0) for c, m in zip(numeric, meds)}
    data = _filled(data, medians)
    label_stage = []
    if task == "classification":
        if not is_numeric_type(types[target]):
            label_stage = [StringIndexer(inputCol=target, outputCol="label",
                                         stringOrderType="alphabetAsc")]
        est = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed,
                                     labelCol="label", featuresCol="features")
    else:
        est = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed,
                                    labelCol="label", featuresCol="features")
    if not label_stage:
        data = data.withColumn("label", col(target).cast("double"))
    # Codes are plain ordered numbers, not nominal ones, which would bound
    # their count by the forest's maxBins.
    asm = VectorAssembler(inputCols=numeric + [f"{c}__code" for c in text], outputCol="features")
    pipe = Pipeline(stages=label_stage + [asm, est])
    if stratify:
        if not key:
            raise ValueError("a stratified split needs a key column")
        parts = stratified_split(data, target, key, seed=seed)
        train, test = parts.where("is_train"), parts.where("NOT is_train")
    else:
        # Stable across partitioning: the hash of the key (or of the whole row).
        hkey = col(key) if key else F.xxhash64(*[col(c) for c in numeric + text + [target]])
        h = F.pmod(F.xxhash64(hkey, F.lit(seed)), F.lit(HASH_SPACE)).cast("double") / float(HASH_SPACE)
        share = SMALL_TEST_SHARE if rule == "library" and data.limit(11).count() <= 10 else TEST_SHARE
        train, test = data.where(h >= share), data.where(h < share)
    model = pipe.fit(train.repartition(tasks))
    scored = written(spark, model.transform(test.repartition(tasks)).drop("features", "rawPrediction"), "scored")
    trained = Trained(model, task, target, numeric + text, numeric, text, medians, evaluate(scored, task), spare, codes, data)
    return trained, scored


def evaluate(scored: DataFrame, task: str) -> dict:
    """M9: accuracy (classification) or R2 (regression); the exact AUC when
    binary."""
    if task == "classification":
        acc = accuracy(scored, "label", "prediction").first()["accuracy"]
        out = {"metric_name": "Accuracy Score", "metric_value": round(acc or 0.0, 4)}
        if scored.select("label").distinct().limit(3).count() == 2:
            out["auc"] = roc_auc(risk_scores(scored), "label", "risk_score").first()["auc"]
        return out
    value = r2(scored, "label", "prediction").first()["r2"]
    return {"metric_name": "R² Score", "metric_value": round(value or 0.0, 4)}


def metrics_frame(spark, trained: Trained) -> DataFrame:
    m = trained.metrics
    return spark.createDataFrame(
        [(trained.task, trained.target, m["metric_name"], float(m["metric_value"]), m.get("auc"))],
        "task string, target string, metric_name string, metric_value double, auc double")


def feature_importances(spark, trained: Trained) -> DataFrame:
    """(feature, importance) descending; importances sum to 1."""
    imp = trained.model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(trained.features, [float(x) for x in imp]), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def accuracy(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """M9 in plain SQL form over a given prediction table."""
    return pred.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("rows"))


def r2(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """M9: 1 - SS_res / SS_tot in one aggregate."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    return pred.agg((1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"),
                    F.count(y).alias("rows"))


# --------------------------------------------------------------------- K4 / M11

def save_model(trained: Trained, path: str) -> None:
    """K4: the pipeline, the codes of the text features, and what else scoring
    needs: features, task, target, medians and metrics."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    rest = {f.name: getattr(trained, f.name) for f in fields(Trained) if f.name not in NOT_IN_BUNDLE}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")
    if trained.codes is not None:
        trained.codes.write.mode("overwrite").parquet(f"{path}/codes")


def load_model(path: str) -> Trained:
    spark = SparkSession.active()
    rest = json.loads(spark.read.text(f"{path}/bundle").first()[0])
    codes = spark.read.parquet(f"{path}/codes") if rest["text"] else None
    return Trained(model=PipelineModel.load(f"{path}/pipeline"), codes=codes, **rest)


def coerced(df: DataFrame, features: list[str], text: list[str] | None = None) -> list[Column]:
    """M11 coercion as columns: absent or non-numeric values become 0.0 (with
    the R11 guard on text); text features the model encodes stay text, a
    missing one becoming the spare category."""
    text = text or []
    out = []
    for c in features:
        if c in text:
            out.append((F.coalesce(col(c).cast("string"), F.lit(MISSING_CATEGORY))
                        if c in df.columns else F.lit(MISSING_CATEGORY)).alias(c))
        elif c not in df.columns:
            out.append(F.lit(0.0).alias(c))
        else:
            # A boolean counts as 0 or 1.
            flag = isinstance(df.schema[c].dataType, T.BooleanType)
            s = F.trim((col(c).cast("int") if flag else col(c)).cast("string"))
            out.append(F.coalesce(F.when(s.rlike(NUMBER_PATTERN), finite(s.try_cast("double"))),
                                  F.lit(0.0)).alias(c))
    return out


def coerce_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """M11 coercion part as a relation."""
    return df.select(*[col(c) for c in (keep or [])], *coerced(df, features))


def score_batch(trained: Trained, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Predict on rows after coercion; text features get their codes
    (unseen or missing text the spare one)."""
    rows = df.select(*[col(c) for c in (keep or [])], *coerced(df, trained.features, trained.text))
    return trained.model.transform(attach_codes(rows, trained.text, trained.codes, trained.spare))


# --------------------------------------------------------------------- H3 / H11

def risk_scores(scored: DataFrame) -> DataFrame:
    """H3: class-1 probability for every row."""
    return scored.withColumn("risk_score", vector_to_array("probability")[1])


def risk_drivers(trained: Trained, data: DataFrame, key: str, label: str, buckets_of: int = 1000,
                 seed: int = SEED) -> DataFrame:
    """H11 (re-aimed): permutation importance, (feature, auc_drop) descending.

    Rows go to buckets of about ``buckets_of`` by a hash of their key and
    values, whatever partition they lie in. Inside a bucket, in hash order,
    every feature also gets the value of the next row. Each row then makes one
    copy for each feature, with that feature's other value, and one unchanged;
    all copies are scored in one pass, and the AUC of each feature's copies
    comes from one grouped count. Equal rows share a bucket.

    data: what ``prepare_features`` or ``Trained.data`` gives, with the key and
    the label (1 for the class whose probability is the risk).
    """
    inputs = trained.model.stages[-2].getInputCols()
    values = F.struct(col(key), *(col(c) for c in inputs), col(label))
    nb = max(1, data.count() // buckets_of)
    rows = data.select(col(label).cast("double").alias("__label"), *(col(c) for c in inputs),
                       F.pmod(F.xxhash64(values, F.lit(seed)), F.lit(nb)).alias("__bucket"),
                       F.xxhash64(values, F.lit(seed + 1)).alias("__order"))
    # Copies are scored where their bucket lies.
    rows = rows.repartition(tasks_for(data), "__bucket")
    w = Window.partitionBy("__bucket").orderBy("__order")
    start = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{c}__other": F.coalesce(F.lead(col(c)).over(w), F.first(col(c)).over(start)) for c in inputs})
    copies = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(len(inputs)))))
    copies = copies.select("__label", "__copy", *(
        F.when(F.col("__copy") == i, col(f"{c}__other")).otherwise(col(c)).alias(c) for i, c in enumerate(inputs, 1)))
    scored = risk_scores(trained.model.transform(copies))
    # One row for each feature, and one.
    found = {r["__copy"]: r["auc"] for r in roc_auc(scored, "__label", "risk_score", by=["__copy"]).collect()}
    drops = [(f, None if found.get(i) is None else float(found[0] - found[i])) for i, f in enumerate(trained.features, 1)]
    drops.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    return data.sparkSession.createDataFrame(drops, "feature string, auc_drop double")


# --------------------------------------------------------------------- churn pipeline

def churn_pipeline(df: DataFrame, key: str, tiers: bool = True) -> tuple[Trained, DataFrame]:
    """The churn batch: target by name (F5), features by name rules (F6),
    codes for text, exact medians, stratified 80/20 split, a forest of 100
    trees of depth 10, AUC on the test part, then every row scored (H3) and
    tiered (H4)."""
    from lumen.functions.roles import find_target, risk_features
    from lumen.operators.risk import risk_tiers
    target = find_target(df)
    feats = risk_features(df, target)
    data = df.withColumn(target, col(target).cast("int"))
    trained, _ = fit_model(data, target, task="classification", features=feats, key=key,
                           trees=CHURN_TREES, depth=CHURN_DEPTH, stratify=True)
    # Gaps are filled with the training medians, as they were for the fit.
    scored = risk_scores(trained.model.transform(trained.data)).select(key, target, "risk_score")
    scored = written(df.sparkSession, scored, "risk-scores")
    # Tiers follow pandas qcut: repeated edges (many equal scores) are an error.
    return trained, (risk_tiers(scored) if tiers else scored)
