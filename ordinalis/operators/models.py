"""Classifiers for the ordered target on MLlib: one interface, real probabilities for every class.

A fitted model has `score(df)`, which adds p0, p1, p2 and yp, and `save(path)`; `load_model(spark, path)` reads it back.
Inputs hold a vector `features` and an integer class `y`.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.functions.scalar import argmax3
from ordinalis.operators import isotonic
from ordinalis.operators.calibration import by_class
from ordinalis.operators.evaluation import evaluate, to_long
from ordinalis.session import settle

K = 3


def class_weight(train: DataFrame, label: str = "y") -> Column:
    """Balanced weights n / (K * n_c); the counts are K numbers."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    out = F
    for k, c in counts.items():
        out = out.when(F.col(label) == k, float(n) / (len(counts) * c))
    return out.otherwise(0.0)


def with_weights(train: DataFrame) -> DataFrame:
    """Training rows with their class weight `_w`; rows that have it already come back as they are."""
    return train if "_w" in train.columns else train.withColumn("_w", class_weight(train))


def _positive(stage, df: DataFrame, name: str) -> DataFrame:
    """Probability of the second class of a binary model as column `name`."""
    out = stage.transform(df)
    keep = [F.col(f"`{x}`") for x in df.columns]
    return out.select(*keep, vector_to_array(stage.getProbabilityCol()).getItem(1).alias(name))


@dataclass
class Classifier:
    """Stages of one model family; how their outputs combine depends on `kind`."""
    kind: str
    stages: list

    def score(self, df: DataFrame) -> DataFrame:
        base = df.drop("p0", "p1", "p2", "yp")
        if self.kind == "logistic":
            out = self.stages[0].transform(base)
            p = vector_to_array(self.stages[0].getProbabilityCol())
            out = out.select(*[F.col(f"`{x}`") for x in base.columns], *[p.getItem(k).alias(f"p{k}") for k in range(K)])
        elif self.kind == "ordinal":
            # P(y > 0) and P(y > 1), made monotone
            out = _positive(self.stages[1], _positive(self.stages[0], base, "_a"), "_b")
            upper = F.least("_a", "_b")
            out = out.withColumns({"p0": 1.0 - F.col("_a"), "p1": F.col("_a") - upper, "p2": upper}).drop("_a", "_b")
        else:
            out = base
            for k, stage in enumerate(self.stages):
                out = _positive(stage, out, f"_b{k}")
            total = F.col("_b0") + F.col("_b1") + F.col("_b2")
            out = out.withColumns({f"p{k}": F.col(f"_b{k}") / total for k in range(K)}).drop("_b0", "_b1", "_b2")
        return out.withColumn("yp", argmax3(F.col("p0"), F.col("p1"), F.col("p2")))

    def save(self, path: str) -> None:
        for i, stage in enumerate(self.stages):
            stage.write().overwrite().save(f"{path}/{self.kind}-{i}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.kind, len(self.stages))], "kind string, n int").write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Classifier:
    kind, n = spark.read.json(f"{path}/meta").select("kind", "n").first()
    reader = GBTClassificationModel if kind == "boosted" else LogisticRegressionModel
    return Classifier(kind, [reader.load(f"{path}/{kind}-{i}") for i in range(n)])


def fit_logistic(train: DataFrame, reg: float = 0.01, elastic: float = 0.0, iterations: int = 100) -> Classifier:
    rows = with_weights(train)
    lr = LogisticRegression(labelCol="y", weightCol="_w", family="multinomial", regParam=reg, elasticNetParam=elastic,
                            maxIter=iterations)
    return Classifier("logistic", [lr.fit(rows)])


def fit_ordinal(train: DataFrame, reg: float = 0.01, iterations: int = 100) -> Classifier:
    """One binary model per threshold of the ordered target."""
    stages = []
    for k in range(K - 1):
        rows = train.withColumn("_t", (F.col("y") > k).cast("int"))
        stages.append(LogisticRegression(labelCol="_t", regParam=reg, maxIter=iterations, probabilityCol=f"_prob{k}",
                                         rawPredictionCol=f"_raw{k}", predictionCol=f"_pred{k}").fit(rows))
    return Classifier("ordinal", stages)


def fit_boosted(train: DataFrame, depth: int = 4, iterations: int = 20, step: float = 0.1, seed: int = 42) -> Classifier:
    """Boosted trees, one-vs-rest with normalised probabilities; the three fits run side by side."""
    weighted = with_weights(train)

    def one(k: int):
        rows = weighted.withColumn("_t", (F.col("y") == k).cast("int"))
        model = GBTClassifier(labelCol="_t", weightCol="_w", maxDepth=depth, maxIter=iterations, stepSize=step, seed=seed).fit(rows)
        return model.setProbabilityCol(f"_prob{k}").setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_pred{k}")

    with ThreadPoolExecutor(K) as pool:
        return Classifier("boosted", list(pool.map(one, range(K))))


FITTERS: dict[str, Callable[..., Classifier]] = {"logistic": fit_logistic, "ordinal": fit_ordinal, "boosted": fit_boosted}
GRIDS: dict[str, dict[str, list]] = {
    "logistic": {"reg": [0.001, 0.01, 0.1], "elastic": [0.0, 1.0]},
    "ordinal": {"reg": [0.001, 0.01, 0.1]},
    "boosted": {"depth": [3, 5], "step": [0.05, 0.2]}}


def run_baselines(df: DataFrame, targets: dict[str, str], models: list[str] | None = None,
                  params: dict[str, dict] | None = None, parallel: int = 4) -> DataFrame:
    """(target, model, split, n, metrics...): every model on every target, all splits evaluated in one pass.

    Fits run side by side as ordinary Spark jobs, `parallel` at a time; each target's training rows are weighted once.
    """
    rows = {target: df.withColumn("y", F.col(column)) for target, column in targets.items()}
    with ThreadPoolExecutor(parallel) as pool:
        trains = dict(zip(rows, pool.map(lambda r: settle(with_weights(r.filter("split = 'train'").select("features", "y"))), rows.values())))

        def one(pair: tuple[str, str]) -> DataFrame:
            target, name = pair
            out = FITTERS[name](trains[target], **(params or {}).get(name, {})).score(rows[target])
            return out.select(F.lit(target).alias("target"), F.lit(name).alias("model"), "split", "id", "y", "yp", "p0")

        scored = reduce(DataFrame.unionByName, list(pool.map(one, product(rows, models or FITTERS))))
    return evaluate(settle(scored), ["target", "model", "split"])


def tune(df: DataFrame, name: str, grid: dict[str, list] | None = None, metric: str = "qwk",
         parallel: int = 4) -> tuple[DataFrame, dict]:
    """Fit each grid point on `train`, rank by a metric on `val`; returns the trial log and the best parameters.

    Trials run concurrently as ordinary Spark jobs and all are evaluated by one grouped aggregation.
    """
    spark = df.sparkSession
    grid = grid or GRIDS[name]
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    train = settle(df.filter("split = 'train'").select("features", "y"))
    val = settle(df.filter("split = 'val'").select("id", "features", "y"))
    with ThreadPoolExecutor(parallel) as pool:
        fitted = list(pool.map(lambda p: FITTERS[name](train, **p), points))
    scored = None
    for number, model in enumerate(fitted):
        out = model.score(val).select(F.lit(number).alias("number"), "id", "y", "yp", "p0")
        scored = out if scored is None else scored.unionByName(out)
    values = to_long(evaluate(scored, ["number"], probabilities=False), ["number"]).filter(F.col("metric") == metric)
    log = values.collect()  # one row per trial
    best = max(log, key=lambda r: (r["value"] if r["value"] is not None else float("-inf"), -r["number"]))
    rows = [(name, r["number"], r["value"], ", ".join(f"{k}={v}" for k, v in points[r["number"]].items())) for r in log]
    return spark.createDataFrame(rows, "model string, number int, value double, params string"), points[best["number"]]


# --- feature spaces ----------------------------------------------------------------------------------------------

def with_text(df: DataFrame, embeddings: DataFrame, key: str, vector: str = "embedding", name: str = "text_vector") -> DataFrame:
    """All rows with their text vector as an ML vector; rows without one get a zero vector, as empty texts do."""
    width = embeddings.agg(F.max(F.size(vector))).first()[0] or 0
    found = embeddings.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda v: v.cast("double")).alias("_vector"))
    zero = F.array_repeat(F.lit(0.0), width)
    return df.join(found, key, "left").withColumn(name, array_to_vector(F.coalesce("_vector", zero))).drop("_vector")


def concat_features(df: DataFrame, parts: list[str], name: str = "hybrid") -> DataFrame:
    return VectorAssembler(inputCols=parts, outputCol=name).transform(df)


def fit_pca(train: DataFrame, column: str, k: int, name: str = "components") -> PipelineModel:
    """Centre, then project; fitted on the training rows only."""
    return Pipeline(stages=[StandardScaler(inputCol=column, outputCol=f"_{column}_c", withMean=True, withStd=False),
                            PCA(k=k, inputCol=f"_{column}_c", outputCol=name)]).fit(train)


def pca_loadings(spark: SparkSession, model: PipelineModel, top: int) -> DataFrame:
    """(component, dim, abs_loading, rank, explained): strongest dimensions of each component (signs are arbitrary)."""
    from ordinalis.operators.ranking import top_k_per_group
    pca = model.stages[-1]
    matrix, explained = pca.pc.toArray(), pca.explainedVariance.toArray()
    rows = [(j + 1, i, abs(float(matrix[i, j])), float(explained[j]))
            for j in range(matrix.shape[1]) for i in range(matrix.shape[0])]  # dims x components model parameters
    df = spark.createDataFrame(rows, "component int, dim int, abs_loading double, explained double")
    return top_k_per_group(df, ["component"], [F.col("abs_loading").desc(), F.col("dim").asc()], top)


# --- recalibration -----------------------------------------------------------------------------------------------

def _normalised(df: DataFrame) -> DataFrame:
    total = F.col("q0") + F.col("q1") + F.col("q2")
    return df.withColumns({f"q{k}": F.when(total > 0, F.col(f"q{k}") / total).when(total.isNotNull(), 1.0 / K) for k in range(K)})


def isotonic_recalibrate(val: DataFrame, df: DataFrame) -> DataFrame:
    """Add q0..q2: one monotone map per class fitted on `val`, rows renormalised.  yp stays as it is.

    A row without probabilities gets none.
    """
    blocks = isotonic.fit(by_class(val.where(F.col("y").isNotNull()), []), ["class_idx"], "p", "hit")
    table = isotonic.knots(blocks, ["class_idx"])
    out = df
    for k in range(K):
        out = isotonic.apply(out, table.where(F.col("class_idx") == k).select("x", "q"), f"p{k}", f"q{k}")
    return _normalised(out)


def platt_recalibrate(val: DataFrame, df: DataFrame) -> DataFrame:
    """Same with a sigmoid per class."""
    out = df
    for k in range(K):
        as_vector = array_to_vector(F.array(F.col(f"p{k}").cast("double")))
        fit_rows = val.select(as_vector.alias("_x"), (F.col("y") == k).cast("int").alias("_h"))
        model = LogisticRegression(featuresCol="_x", labelCol="_h", probabilityCol=f"_prob{k}", rawPredictionCol=f"_raw{k}",
                                   predictionCol=f"_pred{k}").fit(fit_rows)
        out = _positive(model, out.withColumn("_x", as_vector), f"q{k}").drop("_x")
    return _normalised(out)
