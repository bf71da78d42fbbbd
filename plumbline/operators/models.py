"""Models on MLlib: splits, training, scoring, out-of-fold search and linear explanations."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import missing, numeric_columns, ref
from plumbline.functions.joins import null_safe_join
from plumbline.operators import metrics, tables
from plumbline.operators.ordered import running_totals

TEST_SHARE = 0.2
SEED = 42

# Algorithms by problem type; a name maps to a function from parameters to an estimator.
ALGORITHMS: dict[str, dict[str, Callable[..., Estimator]]] = {
    "classification": {
        "logistic_regression": LogisticRegression,
        "random_forest": lambda **p: RandomForestClassifier(**{"seed": SEED, **p}),
        "gradient_boosting": lambda **p: GBTClassifier(**{"seed": SEED, **p}),
        "decision_tree": lambda **p: DecisionTreeClassifier(**{"seed": SEED, **p}),
        "neural_network": lambda **p: MultilayerPerceptronClassifier(**{"seed": SEED, **p}),
    },
    "regression": {
        "linear_regression": LinearRegression,
        "ridge": lambda **p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, "standardization": False, **p}),
        "lasso": lambda **p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0, "standardization": False, **p}),
        "random_forest": lambda **p: RandomForestRegressor(**{"seed": SEED, **p}),
        "gradient_boosting": lambda **p: GBTRegressor(**{"seed": SEED, **p}),
        "decision_tree": lambda **p: DecisionTreeRegressor(**{"seed": SEED, **p}),
    },
    "clustering": {"kmeans": lambda **p: KMeans(**{"k": 8, "seed": SEED, **p})},
}
DEFAULTS = {
    "classification": ["logistic_regression", "random_forest", "decision_tree"],
    "regression": ["linear_regression", "random_forest", "ridge"],
    "clustering": ["kmeans"],
}


def register_algorithm(problem: str, name: str, factory: Callable[..., Estimator]) -> None:
    ALGORITHMS.setdefault(problem, {})[name] = factory


# ---------------------------------------------------------------- splits

def row_hash(keys: Sequence[str], seed: int = SEED) -> Column:
    """32-bit number from the MD5 of the key columns and a seed: the same on any partitioning."""
    text = F.concat_ws("|", *[ref(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def train_test_split(df: DataFrame, keys: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    cut = int(test_share * 2**32)
    drawn = row_hash(keys, seed)
    return df.where(drawn >= cut), df.where(drawn < cut)


def class_places(df: DataFrame, keys: Sequence[str], label: str, seed: int = SEED) -> DataFrame:
    """Add ``_place`` (1-based order by hash) and ``_size`` of each row within its class.

    Places are prefix counts over ranges of the hash: a class of any size is spread evenly.
    """
    drawn = df.withColumn("_hash", row_hash(keys, seed)).withColumn("_one", F.lit(1))
    placed = running_totals(drawn, ["_hash", *keys], {"_place": "_one"}, [label])
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    return null_safe_join(placed, sizes, [label]).drop("_one", "_hash")


def stratified_split(
    df: DataFrame, keys: Sequence[str], label: str, test_share: float = TEST_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Split with the same test share in every class, exact to the rounded row."""
    placed = class_places(df, keys, label, seed)
    test = F.col("_place") <= F.floor(F.col("_size") * test_share + 0.5)
    return placed.where(~test).select(*df.columns), placed.where(test).select(*df.columns)


def folds(df: DataFrame, keys: Sequence[str], count: int, label: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 0..count-1: by hash, or round-robin within each class."""
    if label is None:
        return df.withColumn("fold", (row_hash(keys, seed) % count).cast("int"))
    placed = class_places(df, keys, label, seed)
    return placed.select(*df.columns, ((F.col("_place") - 1) % count).cast("int").alias("fold"))


# ---------------------------------------------------------------- training and scoring

def create(problem: str, algorithm: str, **params: Any) -> Estimator:
    algorithm = algorithm.lower().strip()
    if problem not in ALGORITHMS:
        raise ValueError(f"Unsupported problem type: {problem}")
    if algorithm not in ALGORITHMS[problem]:
        raise ValueError(f"Unknown algorithm {algorithm!r} for {problem}")
    return ALGORITHMS[problem][algorithm](**params)


def usable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of ``columns`` is NULL or NaN."""
    return df.where(reduce(lambda a, b: a & b, [~missing(df, c) for c in columns], F.lit(True)))


def train(
    df: DataFrame, problem: str, algorithm: str, features: Sequence[str], target: str | None = None, **params: Any
) -> PipelineModel:
    """Fit one algorithm on numeric feature columns; class labels may be of any type.

    Rows with a missing feature or label are left out of the fit (``usable`` selects them).
    Ridge minimises squared errors plus ``alpha`` (1 by default) times the squared weights, so
    its penalty is divided by the number of rows (the solver divides it by the label's
    deviation, which is taken back); lasso halves the mean squared error.
    """
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")]
    ridge = problem == "regression" and algorithm.lower().strip() == "ridge"
    alpha = params.pop("alpha", 1.0) if ridge else None
    model = create(problem, algorithm, **params)
    if problem == "classification":
        classes = sorted(str(r[0]) for r in df.select(ref(target).cast("string")).where(ref(target).isNotNull()).distinct().collect())
        indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc")
        if isinstance(model, MultilayerPerceptronClassifier) and not model.isSet("layers"):
            model = model.copy({model.layers: [len(features), 16, len(classes)]})
        names = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=classes)
        return Pipeline(stages=[*stages, indexer.setHandleInvalid("skip"), model, names]).fit(df)
    if problem == "regression":
        df = usable(df, [*features, target])
        model = model.copy({model.labelCol: target})
        if ridge and "regParam" not in params:
            rows, spread = df.agg(F.count(F.lit(1)), F.stddev_samp(ref(target).cast("double"))).first()
            model = model.copy({model.regParam: alpha * (spread or 1.0) / max(1, rows)})
    return Pipeline(stages=[*stages, model]).fit(df)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions for new rows (batch or stream), with the highest class probability as
    confidence where the model gives one. Rows need no label.

    Every row comes back: one with a missing feature has no result, and ``reason`` names the
    missing features; elsewhere ``reason`` is NULL.
    """
    stages = [s for s in model.stages if type(s).__name__ != "StringIndexerModel"]
    inputs = [c for s in stages if isinstance(s, VectorAssembler) for c in s.getInputCols()]
    stages = [s.copy({s.handleInvalid: "keep"}) if isinstance(s, VectorAssembler) else s for s in stages]
    gaps = F.array_compact(F.array(*[F.when(missing(df, c), F.lit(c)) for c in inputs]))
    out = PipelineModel(stages).transform(df.withColumn("_gaps", gaps))
    whole = F.size("_gaps") == 0
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    result = F.col("predicted_class") if "predicted_class" in out.columns else F.col("prediction")
    extra = [F.when(whole, vector_to_array("probability")).alias("class_probabilities")] if "probability" in out.columns else []
    reason = F.when(~whole, F.concat(F.lit("missing features: "), F.array_join("_gaps", ", "))).alias("reason")
    return out.select(*df.columns, F.when(whole, result).alias("result"), F.when(whole, sure).alias("confidence"), *extra, reason)


def prediction_log(scored: DataFrame, model_name: str, version: str, features: Sequence[str], created: str) -> DataFrame:
    """Scored rows as log records: inputs as JSON, result, confidence, day for the layout."""
    stamp = F.lit(created).cast("timestamp_ntz")
    return scored.select(
        F.lit(model_name).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.to_json(F.struct(*features)).alias("input_payload"),
        F.col("result").cast("string").alias("prediction_result"),
        "confidence",
        stamp.alias("created_at"),
        F.to_date(stamp).alias("day"),
    )


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").partitionBy("day", "model_name").parquet(path)


# ---------------------------------------------------------------- search

def out_of_fold(
    df: DataFrame, problem: str, algorithm: str, features: Sequence[str], target: str, fold_count: int, **params: Any
) -> DataFrame:
    """Predictions for every row by a model that has not seen it; ``df`` has a ``fold``."""
    parts = []
    for i in range(fold_count):
        model = train(df.where(F.col("fold") != i), problem, algorithm, features, target, **params)
        parts.append(score(model, df.where(F.col("fold") == i)))
    return reduce(DataFrame.unionByName, parts)


def class_metrics(predicted: DataFrame, target: str, positive: str | None = None) -> dict[str, float]:
    classes = sorted(str(r[0]) for r in predicted.select(ref(target).cast("string")).distinct().collect())
    positive = positive or classes[-1]
    named = predicted.withColumn(target, ref(target).cast("string"))
    row = metrics.classification_metrics(named, target, "result", positive).first().asDict()
    if "class_probabilities" in predicted.columns:
        spread = named.select(
            target, *[F.element_at("class_probabilities", i + 1).alias(f"p{i}") for i in range(len(classes))]
        )
        if len(classes) == 2:
            k = classes.index(positive)
            row.update(metrics.ranking_metrics(spread, target, f"p{k}", positive).first().asDict())
        else:
            scores = {c: f"p{i}" for i, c in enumerate(classes)}
            row.update(metrics.roc_auc_one_vs_rest(spread, target, scores).first().asDict())
    return {k: v for k, v in row.items() if v is not None}


def cluster_metrics(df: DataFrame, model: PipelineModel) -> dict[str, float]:
    """Silhouette (squared Euclidean, linear time), Davies-Bouldin and Calinski-Harabasz."""
    out = model.transform(df)
    labels = out.select("prediction").distinct().count()
    if labels <= 1:
        return {"silhouette_score": 0.0, "davies_bouldin": 0.0, "calinski_harabasz": 0.0}
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(out)
    rest = metrics.cluster_scores(out.withColumn("_v", vector_to_array("features")), "prediction", "_v").first().asDict()
    return {"silhouette_score": silhouette, **rest}


def search(
    df: DataFrame,
    problem: str,
    features: Sequence[str],
    target: str | None = None,
    keys: Sequence[str] = (),
    algorithms: Sequence[str] | None = None,
    fold_count: int = 5,
    primary_metric: str | None = None,
    params: dict[str, dict] | None = None,
) -> DataFrame:
    """Leaderboard over algorithms by out-of-fold metrics; one that fails is left out.

    The table with its folds is persisted for the many fits (spilling to disk).
    """
    rows = []
    errors = []
    kept = df.select(*dict.fromkeys([*keys, *features, *([target] if target else [])]))
    base = kept if problem == "clustering" else folds(kept, keys, fold_count, target if problem == "classification" else None)
    base = base.persist()
    try:
        for algorithm in algorithms or DEFAULTS[problem]:
            options = (params or {}).get(algorithm, {})
            started = time.monotonic()
            try:
                if problem == "clustering":
                    found = cluster_metrics(base, train(base, problem, algorithm, features, **options))
                else:
                    predicted = out_of_fold(base, problem, algorithm, features, target, fold_count, **options)
                    predicted = predicted.drop(*keys, *features).persist()
                    try:
                        if problem == "classification":
                            found = class_metrics(predicted, target)
                        else:
                            found = metrics.regression_metrics(predicted, target, "result").first().asDict()
                    finally:
                        predicted.unpersist()
                rows.append((algorithm, {k: float(v) for k, v in found.items()}, round(time.monotonic() - started, 2)))
            except Exception as exc:  # noqa: BLE001 - one failing algorithm does not stop the others
                errors.append(f"{algorithm}: {exc}")
    finally:
        base.unpersist()
    if not rows:
        raise RuntimeError("No algorithms succeeded in training: " + "; ".join(errors))
    names = sorted({m for _, found, _ in rows for m in found})
    schema = "position int, algorithm string, seconds double, " + ", ".join(f"{m} double" for m in names)
    data = [(i, a, s, *[found.get(m) for m in names]) for i, (a, found, s) in enumerate(rows)]
    table = df.sparkSession.createDataFrame(data, schema)
    return tables.leaderboard(table, primary_metric, problem, tie="position").drop("position")


# ---------------------------------------------------------------- explanations

def linear_contributions(df: DataFrame, weights: dict[str, float], means: dict[str, float], intercept: float) -> DataFrame:
    """Exact Shapley values of a linear model: ``weight * (x - mean)`` per feature, and the
    base value they add up from."""
    base = intercept + sum(w * means[c] for c, w in weights.items())
    return df.select(
        "*", F.lit(base).alias("base_value"),
        *[(F.lit(w) * (ref(c) - F.lit(means[c]))).alias(f"{c}__contribution") for c, w in weights.items()],
    )


def explain_linear(model: PipelineModel, background: DataFrame, df: DataFrame) -> DataFrame:
    """Contributions of a fitted linear model against the means of ``background``."""
    names = model.stages[0].getInputCols()
    fitted = next(s for s in model.stages if hasattr(s, "coefficients"))
    row = background.agg(*[F.avg(ref(c)).alias(c) for c in names]).first()
    weights = dict(zip(names, (float(x) for x in fitted.coefficients.toArray())))
    return linear_contributions(df, weights, {c: row[c] for c in names}, float(fitted.intercept))


def default_features(df: DataFrame, target: str | None = None, exclude: Sequence[str] = ()) -> list[str]:
    return numeric_columns(df, [*( [target] if target else []), *exclude])
