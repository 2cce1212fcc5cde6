"""Fitted models. Rows of most depend on an optimiser, so they have no SQL; the calibration fit is replayed step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators import models, selection
from paritas.operators import simulation as sim
from paritas.operators.metrics import classification_metrics
from paritas.queries.roles import EVALUATED, evaluated
from paritas.queries.selection import r6
from paritas.queries.simulation import people

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _screen(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Split, fit, score the test rows, select, and compare with the counterfactual under the same model."""
    rows = sim.stratified_split(people(spark, sf_dir), ["group", "label"], ["id"]).cache()
    train, test = rows.where("not is_test"), rows.where("is_test")
    model = models.fit(train, name)
    out = None
    for stage, frame in (("baseline", test), ("counterfactual", sim.counterfactual(test, 0.78, 0.3, 7919))):
        chosen = selection.rank_select(models.score(model, frame), "proba", "id", 0.3)
        part = classification_metrics(chosen).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return r6(out).withColumn("model", F.lit(name))


#: Newton's method for slope and intercept: 25 steps of five sums per group.
SQL["calibration_audit"] = f"""WITH RECURSIVE {EVALUATED},
x AS (SELECT grp AS g, label::DOUBLE AS y, ln(greatest(1e-6, least(1 - 1e-6, proba)) / (1 - greatest(1e-6, least(1 - 1e-6, proba)))) AS x FROM e),
c AS (SELECT g, count(*) AS n, min(y) AS low, max(y) AS high FROM x GROUP BY g),
w AS (SELECT g, 0 AS step, 0.0::DOUBLE AS s, 0.0::DOUBLE AS b FROM c WHERE n >= 10 AND low <> high UNION ALL
  SELECT g, step + 1, s + (gx * h - g1 * hx) / (hxx * h - hx * hx), b + (hxx * g1 - hx * gx) / (hxx * h - hx * hx) FROM (
    SELECT g, step, s, b, sum((y - p) * x) - 1e-6 * s AS gx, sum(y - p) AS g1, sum(p * (1 - p) * x * x) + 1e-6 AS hxx, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p)) AS h
    FROM (SELECT w.g, step, s, b, y, x, 1 / (1 + exp(-(s * x + b))) AS p FROM w JOIN x ON w.g = x.g WHERE step < 25) GROUP BY g, step, s, b))
SELECT 'group_' || i AS part, round(s, 6) AS calibration_slope, round(b, 6) AS calibration_intercept, coalesce(n, 0) AS n
FROM (SELECT unnest([0, 1]) AS i) LEFT JOIN c ON c.g = i LEFT JOIN (SELECT * FROM w WHERE step = 25) AS f ON f.g = i"""


@query
def calibration_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(models.calibration(evaluated(spark, sf_dir)))


@query
def coefficient_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(models.coefficients(models.fit(people(spark, sf_dir), "logistic_regression"), spark))


@query
def sim_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, "logistic_regression")


@query
def sim_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, "random_forest")


@query
def sim_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, "gradient_boosting")


@query
def sim_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, "svm_rbf")
