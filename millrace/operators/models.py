"""Comparison of Spark ML models on one table, and clustering."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import is_numeric, missing_as_null, number, quoted, require_columns, require_numeric
from millrace.operators import encode, impute, scale
from millrace.operators.hypothesis import rank_sums
from millrace.operators.profile import cardinality
from millrace.operators.rank import ranked_columns
from millrace.operators.sample import SEED, uniform
from millrace.operators.shape import few_tasks
from millrace.session import materialise

LOW_CARDINALITY = 11
TRAIN_SHARE = 0.8
MAX_CLASSES = 1000
WORKERS = 4
UNKNOWN_CODE = -1.0


# ---------------------------------------------------------------- features


@dataclass(frozen=True)
class Features:
    """Fitted preparation: means for gaps, unit variance, indicator columns, codes."""

    columns: list[str]
    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in self.columns]
        work = df.select(
            *[quoted(c) for c in kept],
            *[
                (number(df, c) if is_numeric(df, c) else F.coalesce(quoted(c).cast("string"), F.lit("missing"))).alias(c)
                for c in self.columns
            ],
        )
        for step in self.steps:
            work = step.transform(work)
        made = [F.coalesce(quoted(c).cast("double"), F.lit(UNKNOWN_CODE)) for c in work.columns if c not in kept]
        return work.select(*[quoted(c) for c in kept], array_to_vector(F.array(*made)).alias("features"))


def fit_features(df: DataFrame, columns: Sequence[str]) -> Features:
    """Learn the preparation of feature columns.

    Numbers: mean for gaps, then standardised. Texts with at most 11 values:
    'missing' for gaps, one indicator per value, unknown values give only
    zeros. Other texts: codes in sorted order.
    """
    require_columns(df, *columns)
    numbers = [c for c in columns if is_numeric(df, c)]
    texts = [c for c in columns if c not in numbers]
    work = df.select(
        *[number(df, c).alias(c) for c in numbers],
        *[F.coalesce(quoted(c).cast("string"), F.lit("missing")).alias(c) for c in texts],
    )
    steps: list = []
    if numbers:
        means = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        steps += [impute.ConstantFill(c, means[f"m{i}"] or 0.0) for i, c in enumerate(numbers)]
        filled = work
        for step in steps:
            filled = step.transform(filled)
        steps += scale.fit(filled, numbers, "standard").steps
    if texts:
        few = {r["column"] for r in cardinality(work, texts, LOW_CARDINALITY).collect() if r["low"]}
        for c in texts:
            steps += encode.fit(work, [c], "onehot" if c in few else "ordinal").steps
    return Features(list(columns), steps)


# ---------------------------------------------------------------- model pool


def model_pool(
    task: str, classes: int, width: int, depth: int = 5, trees: int = 20, rounds: int = 20
) -> dict[str, Estimator]:
    """Models suited to the task, the same for any number of rows.

    ``depth``, ``trees`` and ``rounds`` of boosting are those that ``pyspark.ml`` has by default.
    """
    if task == "regression":
        return {
            "LinearRegression": R.LinearRegression(),
            "GeneralizedLinearRegression": R.GeneralizedLinearRegression(),
            "DecisionTreeRegressor": R.DecisionTreeRegressor(maxDepth=depth, seed=SEED),
            "RandomForestRegressor": R.RandomForestRegressor(maxDepth=depth, numTrees=trees, seed=SEED),
            "GBTRegressor": R.GBTRegressor(maxDepth=depth, maxIter=rounds, seed=SEED),
            "FMRegressor": R.FMRegressor(seed=SEED, stepSize=0.01),
        }
    if task != "classification":
        raise ValueError(f"unknown task: {task}")
    pool: dict[str, Estimator] = {
        "LogisticRegression": C.LogisticRegression(),
        "GaussianNaiveBayes": C.NaiveBayes(modelType="gaussian"),
        "DecisionTreeClassifier": C.DecisionTreeClassifier(maxDepth=depth, seed=SEED),
        "RandomForestClassifier": C.RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=SEED),
        "MultilayerPerceptronClassifier": C.MultilayerPerceptronClassifier(
            layers=[width, max(4, min(64, width)), classes], seed=SEED
        ),
    }
    for name, binary in {
        "GBTClassifier": C.GBTClassifier(maxDepth=depth, maxIter=rounds, seed=SEED),
        "FMClassifier": C.FMClassifier(seed=SEED, stepSize=0.01),
        "LinearSVC": C.LinearSVC(),
    }.items():
        # Models of two classes: with more, one against the rest for each of them.
        pool[name] = binary if classes == 2 else C.OneVsRest(classifier=binary, parallelism=WORKERS)
    return pool


@dataclass(frozen=True)
class Comparison:
    leaderboard: DataFrame
    predictions: DataFrame | None
    models: dict[str, Model]
    skipped: dict[str, str]


def split(df: DataFrame, seed: int = SEED, key: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of ``key``, or of all columns: equal rows stay together, none falls into both or neither."""
    drawn = uniform(list(key or df.columns), seed) < TRAIN_SHARE
    return df.where(drawn), df.where(~drawn)


def compare(
    train: DataFrame,
    test: DataFrame,
    target: str,
    task: str,
    columns: Sequence[str] | None = None,
    estimators: dict[str, Estimator] | None = None,
    keep_predictions: bool = False,
) -> Comparison:
    """Fit every model of the pool on ``train`` and rank them by their results on ``test``.

    Best first by balanced accuracy or adjusted R². A model that fails stands
    last, without numbers, and ``skipped`` has its error.
    """
    columns = list(columns or [c for c in train.columns if c != target])
    # Stored once: the preparation reads its rows several times, and whatever makes them may be long.
    train, test = (materialise(part.select(*[quoted(c) for c in dict.fromkeys([target, *columns])])) for part in (train, test))
    steps = fit_features(train, columns)
    if task == "regression":
        require_numeric(train, target)
        labels = []
        label = number(train, target).alias("label")
    else:
        found = train.select(quoted(target).cast("string").alias("v")).where("v is not null").distinct()
        labels = sorted(r["v"] for r in found.limit(MAX_CLASSES + 1).collect())
        if not 2 <= len(labels) <= MAX_CLASSES:
            raise ValueError(f"'{target}' has {len(labels)} classes; 2 to {MAX_CLASSES} are possible")
        codes = F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, float(i))])
        label = codes[quoted(target).cast("string")].alias("label")
    ready = []
    for part in (train, test):
        made = steps.transform(part.select(quoted(target), *[quoted(c) for c in columns]))
        ready.append(few_tasks(materialise(made.select(label, "features").where("label is not null"))))
    width = len(ready[0].first()["features"])
    pool = estimators or model_pool(task, len(labels), width)
    models: dict[str, Model] = {}
    scores: list[tuple] = []
    skipped: dict[str, str] = {}

    def run(name: str) -> None:
        start = time.time()
        try:
            model = pool[name].fit(ready[0])
            made = model.transform(ready[1])
            made = materialise(made.select(*[c for c in ("label", "prediction", "probability", "rawPrediction") if c in made.columns]))
            score = _regression_scores(made, width) if task == "regression" else _class_scores(made, len(labels))
        except Exception as error:  # noqa: BLE001 - one failing model must not end the comparison
            skipped[name] = str(error).splitlines()[0]
            scores.append((name, *[None] * (3 if task == "regression" else 4), time.time() - start))
            return
        models[name] = model
        scores.append((name, *score, time.time() - start))

    with ThreadPoolExecutor(WORKERS) as threads:
        list(threads.map(run, pool))
    if task == "regression":
        schema, metric = "model string, r2 double, adj_r2 double, rmse double, seconds double", "adj_r2"
    else:
        schema = "model string, accuracy double, balanced_accuracy double, f1 double, roc_auc double, seconds double"
        metric = "balanced_accuracy"
    board = train.sparkSession.createDataFrame(scores, schema).orderBy(F.desc_nulls_last(metric), "model")
    kept = _predictions(ready[1], models, labels) if keep_predictions else None
    return Comparison(board, kept, models, skipped)


def _predictions(test: DataFrame, models: dict[str, Model], labels: list[str]) -> DataFrame:
    """The test labels beside each model's prediction."""
    table = test
    for name, model in models.items():
        made = model.transform(table)
        table = made.select(*[quoted(c) for c in table.columns], F.col("prediction").alias(name))
    if labels:
        names = F.array(*[F.lit(v) for v in labels])
        for c in ["label", *models]:
            table = table.withColumn(c, F.get(names, quoted(c).cast("int")))
    return table.drop("features")


def _regression_scores(made: DataFrame, width: int) -> tuple[float | None, ...]:
    error = F.col("label") - F.col("prediction")
    row = made.agg(
        F.count("*").alias("n"), F.sum(error * error).alias("left"), (F.var_pop("label") * F.count("*")).alias("total")
    ).first()
    n = row["n"]
    r2 = 1 - row["left"] / row["total"] if row["total"] else None
    adjusted = None if r2 is None or n - width - 1 <= 0 else 1 - (1 - r2) * (n - 1) / (n - width - 1)
    return r2, adjusted, (row["left"] / n) ** 0.5


def _class_scores(made: DataFrame, classes: int) -> tuple[float | None, ...]:
    """Accuracy, mean recall, weighted F1 and area under the ROC curve."""
    cells = made.groupBy("label", "prediction").count().collect()
    total = sum(r["count"] for r in cells)
    actual: dict[float, int] = {}
    guessed: dict[float, int] = {}
    right: dict[float, int] = {}
    for r in cells:
        actual[r["label"]] = actual.get(r["label"], 0) + r["count"]
        guessed[r["prediction"]] = guessed.get(r["prediction"], 0) + r["count"]
        if r["label"] == r["prediction"]:
            right[r["label"]] = r["count"]
    recalls = [right.get(k, 0) / n for k, n in actual.items()]
    f1 = sum(2 * right.get(k, 0) / (n + guessed.get(k, 0)) * n for k, n in actual.items()) / total
    return sum(right.values()) / total, sum(recalls) / len(recalls), f1, _roc_auc(made, classes)


def _roc_auc(made: DataFrame, classes: int) -> float | None:
    """Exact area from mid-ranks of the scores; for more classes one against the rest, weighted by size."""
    score = next((c for c in ("probability", "rawPrediction") if c in made.columns), None)
    if score is None or classes == 2 and score != "probability":
        return _auc(made, F.col("prediction"), 1.0)[0] if classes == 2 else None
    chances = made.select("label", vector_to_array(score).alias("p"))
    if classes == 2:
        return _auc(chances, F.col("p")[1], 1.0)[0]
    # One ranking of all scores, keyed by class.
    values = {str(k): F.get("p", F.lit(k)) for k in range(classes)}
    hits = {str(k): F.col("label") == k for k in range(classes)}
    sums = ranked_columns(chances, values, hits=hits).groupBy("column").agg(
        F.sum(F.col("hits") * F.col("midrank")).alias("rank_sum"), F.sum("hits").alias("n1"), F.max("n").alias("n")
    )
    parts = [((r["rank_sum"] - r["n1"] * (r["n1"] + 1) / 2) / (r["n1"] * (r["n"] - r["n1"])), r["n1"]) for r in sums.where("n1 > 0 and n1 < n").collect()]
    if len(parts) < classes:
        return None
    return sum(a * n for a, n in parts) / sum(n for _, n in parts)


def _auc(made: DataFrame, score, positive: float) -> tuple[float | None, int]:
    table = made.select((F.col("label") == positive).cast("int").alias("g"), score.alias("v"))
    sums = {r["grp"]: r for r in rank_sums(table, "g", "v").collect()}
    if len(sums) < 2:
        return None, sums[1]["n"] if 1 in sums else 0
    n1, n0 = sums[1]["n"], sums[0]["n"]
    return (sums[1]["rank_sum"] - n1 * (n1 + 1) / 2) / (n1 * n0), n1


# ---------------------------------------------------------------- clusters


@dataclass(frozen=True)
class Clusters:
    labelled: DataFrame
    summary: DataFrame


def cluster(
    df: DataFrame, columns: Sequence[str] | None = None, vector: str | None = None, k: int = 3, components: int | None = None, seed: int = SEED
) -> Clusters:
    """K-means on standardised columns or a vector column, optionally on principal components.

    ``labelled`` is the table with a cluster number and, with components, the
    first two of them for a flat view; ``summary`` has inertia, silhouette and
    the variance each component explains.
    """
    ready = _vectors(df, columns, vector)
    explained: list[float] = []
    if components:
        reduction = PCA(k=components, inputCol="features", outputCol="reduced").fit(ready)
        explained = [float(v) for v in reduction.explainedVariance]
        ready = reduction.transform(ready).drop("features").withColumnRenamed("reduced", "features")
        ready = materialise(ready)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready)
    labelled = model.transform(ready)
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled) if k > 1 else None
    if components and components > 1:
        parts = vector_to_array("features")
        labelled = labelled.withColumns({"pc1": parts[0], "pc2": parts[1]})
    summary = df.sparkSession.createDataFrame(
        [(k, float(model.summary.trainingCost), silhouette, explained)],
        "k int, inertia double, silhouette double, explained_variance array<double>",
    )
    return Clusters(labelled.drop("features"), summary)


def nearest_centres(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with ``cluster``, the nearest of given centres (the first of equally near ones), and ``distance``, the square of how far it is.

    Rows with a missing value have neither. The sum of the distances is the inertia.
    """
    require_numeric(df, *columns)
    values = [number(df, c) for c in columns]
    far = [sum((F.pow(v - F.lit(float(x)), F.lit(2.0)) for v, x in zip(values, c, strict=True)), F.lit(0.0)) for c in centres]
    best = F.array_min(F.array(*[F.struct(d.alias("distance"), F.lit(i).alias("cluster")) for i, d in enumerate(far)]))
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    return df.withColumn("_best", F.when(known, best)).withColumns({"cluster": F.col("_best.cluster"), "distance": F.col("_best.distance")}).drop("_best")


def component_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shares of the variance of standardised columns along their principal components, largest first: component (from 1), share."""
    ready = _vectors(df, columns, None)
    model = PCA(k=len(columns), inputCol="features", outputCol="reduced").fit(ready)
    shares = [(i, float(v)) for i, v in enumerate(model.explainedVariance, 1)]
    return df.sparkSession.createDataFrame(shares, "component int, share double")


def class_scores(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """The leaderboard's numbers for a given score of a 0/1 label: n, accuracy, balanced_accuracy, f1, roc_auc."""
    require_numeric(df, label, score)
    made = df.select(number(df, label).alias("label"), number(df, score).alias("p")).where("label is not null and p is not null")
    made = materialise(made.withColumn("prediction", F.when(F.col("p") >= threshold, 1.0).otherwise(0.0)))
    auc, _ = _auc(made, F.col("p"), 1.0)
    row = (made.count(), *_class_scores(made.drop("p"), 2)[:3], auc)
    return df.sparkSession.createDataFrame([row], "n bigint, accuracy double, balanced_accuracy double, f1 double, roc_auc double")


def elbow(df: DataFrame, ks: Sequence[int], columns: Sequence[str] | None = None, vector: str | None = None, seed: int = SEED) -> DataFrame:
    """Inertia and silhouette for several numbers of clusters."""
    ready = materialise(_vectors(df, columns, vector).select("features"))
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(ready)
        quality = ClusteringEvaluator().evaluate(model.transform(ready)) if k > 1 else None
        rows.append((k, float(model.summary.trainingCost), quality))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def _vectors(df: DataFrame, columns: Sequence[str] | None, vector: str | None) -> DataFrame:
    if vector:
        ready = df.withColumn("features", array_to_vector(quoted(vector).cast("array<double>"))).drop(vector)
        return ready
    if not columns:
        raise ValueError("name the columns to cluster on")
    named = [f"_f{i}" for i in range(len(columns))]
    copied = df.withColumns({n: missing_as_null(df, c) for n, c in zip(named, columns, strict=True)})
    return fit_features(copied, named).transform(copied)
