"""Fitted scorers with ``pyspark.ml``, calibration and coefficients."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.scalars import logit
from paritas.operators.simulation import FEATURES, linear_score, power_score

CLOSED = {"linear_score": linear_score, "quadratic_aggregation": lambda: power_score(2), "cubic_aggregation": lambda: power_score(3)}
FITTED = ("logistic_regression", "random_forest", "gradient_boosting", "svm_rbf")


def _classifier(name: str, n_train: int, seed: int):
    if name == "random_forest":
        return RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=250, maxDepth=6, minInstancesPerNode=8, seed=seed)
    if name == "gradient_boosting":
        return GBTClassifier(featuresCol="f", labelCol="label", maxIter=200, stepSize=0.05, maxDepth=2, seed=seed)
    # the same objective as an L2-penalised fit with C = 1
    return LogisticRegression(featuresCol="f", labelCol="label", regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10)


@dataclass(frozen=True)
class Rbf:
    """A logistic fit on random Fourier features: cosines of projections of the scaled features, whose products approximate an RBF kernel."""

    scaler: PipelineModel
    weights: tuple
    shifts: tuple
    model: PipelineModel

    def features(self, df: DataFrame) -> DataFrame:
        z = self.scaler.transform(df).withColumn("za", vector_to_array("z"))
        rows, shifts = F.array(*(F.array(*map(F.lit, w)) for w in self.weights)), F.array(*map(F.lit, self.shifts))
        dot = lambda w: F.aggregate(F.zip_with(w, F.col("za"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        scale = F.lit((2 / len(self.shifts)) ** 0.5)
        return z.withColumn("f", array_to_vector(F.zip_with(rows, shifts, lambda w, b: scale * F.cos(dot(w) + b)))).drop("v", "z", "za")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.features(df))


def fit(train: DataFrame, name: str, features: Sequence[str] = FEATURES, seed: int = 0, fourier: int = 100) -> PipelineModel | Rbf:
    """A scorer fitted on columns ``features`` and ``label``. ``svm_rbf`` is approximated: ``fourier`` random features, gamma of 1 / width."""
    if name not in FITTED:
        raise ValueError(f"unsupported model: {name}")
    assembler = VectorAssembler(inputCols=list(features), outputCol="v")
    if name != "svm_rbf":
        return Pipeline(stages=[assembler, StandardScaler(inputCol="v", outputCol="f", withMean=True), _classifier(name, train.count(), seed)]).fit(train)
    import numpy as np

    rng, width = np.random.default_rng(seed), len(features)
    scaler = Pipeline(stages=[assembler, StandardScaler(inputCol="v", outputCol="z", withMean=True)]).fit(train)
    weights = tuple(tuple(map(float, w)) for w in rng.normal(0, (2 / width) ** 0.5, (fourier, width)))
    half = Rbf(scaler, weights, tuple(map(float, rng.uniform(0, 2 * np.pi, fourier))), None)
    return replace(half, model=Pipeline(stages=[_classifier(name, train.count(), seed)]).fit(half.features(train)))


def score(model: PipelineModel | Rbf | str, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``proba``, of a fitted model or of a closed form by name."""
    if isinstance(model, str):
        return df.withColumn("proba", CLOSED[model]())
    columns = list(keep or df.columns)
    return model.transform(df).withColumn("proba", F.get(vector_to_array("probability"), F.lit(1))).select(*columns, "proba")


def coefficients(model: PipelineModel, spark: SparkSession, features: Sequence[str] = FEATURES) -> DataFrame | None:
    """Standardised coefficients and odds ratios; None unless the model is a logistic regression on the features."""
    if not isinstance(model, PipelineModel):
        return None
    last = model.stages[-1]
    if not isinstance(last, LogisticRegressionModel) or len(last.coefficients) != len(features):
        return None
    rows = [(f, float(w)) for f, w in zip(features, last.coefficients)]
    return spark.createDataFrame(rows, "feature string, standardized_coefficient double").withColumn("odds_ratio_per_1sd_increase", F.exp("standardized_coefficient"))


def calibration(df: DataFrame, proba: str = "proba", group: str = "group", label: str = "label", rounds: int = 25, penalty: float = 1e-6) -> DataFrame:
    """Per group: slope and intercept of a logistic fit of the label on the logit of the score; null below 10 rows or with one class.

    Newton's method for both groups at once: each round is one aggregation of five sums per group, of which two rows
    come to the driver.
    """
    rows = df.where(F.col(group).isin(0, 1)).select(F.col(group).alias("g"), F.col(label).cast("double").alias("y"), logit(F.col(proba)).alias("x")).cache()
    base = {r["g"]: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).collect()}
    live = {g: [0.0, 0.0] for g, r in base.items() if r["n"] >= 10 and r["a"] != r["b"]}
    for _ in range(rounds):
        if not live:
            break
        slope = F.lit(None).cast("double")
        bias = F.lit(None).cast("double")
        for g, (s, b) in live.items():
            slope, bias = F.when(F.col("g") == g, s).otherwise(slope), F.when(F.col("g") == g, b).otherwise(bias)
        p = 1 / (1 + F.exp(-(slope * F.col("x") + bias)))
        w, d = F.col("p") * (1 - F.col("p")), F.col("y") - F.col("p")
        sums = rows.where(F.col("g").isin(list(live))).withColumn("p", p).groupBy("g").agg(
            F.sum(d * F.col("x")).alias("gx"), F.sum(d).alias("g1"), F.sum(w * F.col("x") * F.col("x")).alias("hxx"), F.sum(w * F.col("x")).alias("hx"), F.sum(w).alias("h")
        )
        moved = 0.0
        for r in sums.collect():
            s, b = live[r["g"]]
            gx, hxx = r["gx"] - penalty * s, r["hxx"] + penalty
            det = hxx * r["h"] - r["hx"] ** 2
            if abs(det) < 1e-18:
                continue
            ds, db = (gx * r["h"] - r["g1"] * r["hx"]) / det, (hxx * r["g1"] - r["hx"] * gx) / det
            live[r["g"]] = [s + ds, b + db]
            moved = max(moved, abs(ds), abs(db))
        if moved < 1e-9:
            break
    rows.unpersist()
    out = [(f"group_{g}", *(live.get(g) or (None, None)), int(base[g]["n"]) if g in base else 0) for g in (0, 1)]
    return df.sparkSession.createDataFrame(out, "part string, calibration_slope double, calibration_intercept double, n long")
