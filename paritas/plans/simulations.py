"""Simulated screenings: replicates of generator, split, scorer and selection, with percentile intervals.

Closed-form scorers run all anchorings and replicates in one plan. Fitted scorers need a fit per replicate; those are
separate jobs, each distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.operators import models, selection
from paritas.operators import simulation as sim
from paritas.operators.metrics import classification_metrics, percentile_interval

METRICS = (
    "disparate_impact", "statistical_parity_difference", "equal_opportunity_difference", "false_positive_rate_difference",
    "selection_rate_group0", "selection_rate_group1", "accuracy",
)
#: What is added to the seed for redrawn sentiments, and for disclosed rows.
REDRAW, DISCLOSE = 7919, 99991


def population(spark: SparkSession, anchorings: Sequence[tuple], n: int, reps: int, sd: float, seed: int, ids: DataFrame | None = None) -> DataFrame:
    """Applicants of every anchoring and replicate: ``n``, or one for each row of ``ids`` (a column ``id``)."""
    table = F.broadcast(spark.createDataFrame([(a, float(lo), float(hi)) for a, lo, hi in anchorings], "anchoring string, low double, high double"))
    ids = (spark.range(n) if ids is None else ids.select("id")).crossJoin(table).crossJoin(F.broadcast(spark.range(reps).withColumnRenamed("id", "rep")))
    return sim.applicants(ids, seed, F.col("low"), F.col("high"), sd, F.concat_ws("/", "anchoring", F.col("rep").cast("string")))


def scored_tests(people: DataFrame, model: str, seed: int) -> DataFrame:
    """The test rows (30 % of each group and label) of every replicate, with ``proba`` and, redrawn, ``cf_proba``."""
    cells = ["anchoring", "rep"]
    split = sim.stratified_split(people, ["group", "label"], ["id"], 0.3, seed, cells)
    redraw = lambda df, sd: sim.counterfactual(df, F.col("high"), sd, seed + REDRAW, ("anchoring", "rep", "id"))
    keep = [*cells, "id", "group", "label", "high", *sim.FEATURES]
    if model in models.CLOSED:
        test = models.score(model, split.where("is_test").select(*keep))
        after = models.score(model, redraw(test.drop("proba"), people_sd(people)))
        return test.join(after.select(*cells, "id", F.col("proba").alias("cf_proba")), [*cells, "id"])
    split, out = split.cache(), None
    for row in split.select(*cells).distinct().orderBy(*cells).collect():
        part = split.where((F.col("anchoring") == row[0]) & (F.col("rep") == row[1]))
        fitted = models.fit(part.where("not is_test"), model, seed=seed + row[1])
        test = models.score(fitted, part.where("is_test").select(*keep), keep)
        after = models.score(fitted, redraw(test.drop("proba"), people_sd(people)), keep)
        done = test.join(after.select(*cells, "id", F.col("proba").alias("cf_proba")), [*cells, "id"])
        out = done if out is None else out.unionByName(done)
    return out


_SD = "sd_"


def people_sd(people: DataFrame) -> float:
    """The deviation of sentiments that the population was drawn with."""
    return float(people.schema["narrative_sentiment"].metadata.get(_SD, 0.3))


def with_sd(people: DataFrame, sd: float) -> DataFrame:
    return people.withMetadata("narrative_sentiment", {_SD: sd})


def screening(spark: SparkSession, anchorings: Sequence[tuple] = sim.ANCHORINGS, n: int = 6000, invite: float = 0.30, sd: float = 0.30, reps: int = 1000, seed: int = 42, model: str = "logistic_regression", ids: DataFrame | None = None) -> DataFrame:
    """Per anchoring and metric: median, mean and interval over replicates."""
    tests = scored_tests(with_sd(population(spark, anchorings, n, reps, sd, seed, ids), sd), model, seed)
    per = classification_metrics(selection.rank_replicates(tests, "proba", "id", invite, ["anchoring", "rep"]), cells=["anchoring", "rep"])
    long = per.unpivot(["anchoring", "rep"], list(METRICS), "metric", "value")
    return percentile_interval(long, "value", ["anchoring", "metric"])


def counterfactual(spark: SparkSession, anchorings: Sequence[tuple] = sim.ANCHORINGS, n: int = 6000, invite: float = 0.12, sd: float = 0.10, reps: int = 100, seed: int = 0, model: str = "logistic_regression") -> DataFrame:
    """Per anchoring and stage (baseline, counterfactual): intervals of the ratio and the selection rates."""
    tests = scored_tests(with_sd(population(spark, anchorings, n, reps, sd, seed), sd), model, seed)
    out, cells = None, ["anchoring", "rep"]
    for stage, column in (("baseline", "proba"), ("counterfactual", "cf_proba")):
        per = selection.group_rates(selection.rank_replicates(tests, column, "id", invite, cells), "group", "yhat", cells).withColumn("stage", F.lit(stage))
        out = per if out is None else out.unionByName(per)
    long = out.unpivot(["anchoring", "stage", "rep"], ["disparate_impact", "selection_rate_group0", "selection_rate_group1"], "metric", "value")
    return percentile_interval(long, "value", ["anchoring", "stage", "metric"])


def disclosure_sweep(spark: SparkSession, anchoring: tuple, rates: Sequence[float] = sim.DISCLOSURE_RATES, n: int = 6000, invite: float = 0.12, sd: float = 0.30, reps: int = 100, seed: int = 0, model: str = "linear_score", ids: DataFrame | None = None) -> DataFrame:
    """Per rate of disclosure: intervals of the ratio and the selection rates. Fitted models are trained once a replicate, on what the rate leaves."""
    people = population(spark, [anchoring], n, reps, sd, seed, ids)
    rows = sim.disclosure(people, rates, float(anchoring[2]), sd, seed + DISCLOSE, ["anchoring", "rep"])
    cells = ["rate", "rep"]
    if model in models.CLOSED:
        scored = models.score(model, sim.stratified_split(rows, ["group", "label"], ["id"], 0.3, seed, cells).where("is_test"))
    else:
        split, scored = sim.stratified_split(rows, ["group", "label"], ["id"], 0.3, seed, cells).cache(), None
        for r in split.select(*cells).distinct().orderBy(*cells).collect():
            part = split.where((F.col("rate") == r[0]) & (F.col("rep") == r[1]))
            keep = [*cells, "id", "group", "label"]
            done = models.score(models.fit(part.where("not is_test"), model, seed=seed + r[1]), part.where("is_test"), keep)
            scored = done if scored is None else scored.unionByName(done)
    per = selection.group_rates(selection.rank_replicates(scored, "proba", "id", invite, cells), "group", "yhat", cells)
    long = per.unpivot(cells, ["disparate_impact", "selection_rate_group0", "selection_rate_group1"], "metric", "value")
    return percentile_interval(long, "value", ["rate", "metric"])


def bootstrap_metrics(spark: SparkSession, replicate, reps: int, seed: int = 0, metrics: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Any replicate function, from a seed to a dict of metrics: rows (metric, interval) over seeds ``seed``, ``seed`` + 1, ...

    Runs on executors. ``metrics``: only these; one that a replicate lacks is undefined there.
    """

    def one(_: dict, at: int) -> dict:
        told = replicate(at)
        return told if metrics is None else {m: told.get(m, float("nan")) for m in metrics}

    return parameter_sweep(spark, [{}], one, reps, seed, "none_ string", alpha).drop("none_")


def model_bars(stages: DataFrame) -> DataFrame:
    """Rows (model, anchoring, stage, point, ci_lo, ci_hi, passes) of the ratio: what bars grouped by model show; passes within [0.8, 1.25].

    ``stages``: results of ``counterfactual`` with a column ``model``.
    """
    from paritas.functions.scalars import four_fifths

    rows = stages.where("metric = 'disparate_impact'")
    return rows.select("model", "anchoring", "stage", "point", "ci_lo", "ci_hi", four_fifths(F.col("point"), True).alias("passes"))


def parameter_sweep(spark: SparkSession, grid: Sequence[dict], replicate, reps: int, seed: int, schema: str, alpha: float = 0.05) -> DataFrame:
    """Any replicate function over a grid of parameters: rows (parameters, metric, interval).

    ``replicate``: from (parameters, seed) to a dict of metrics; runs on executors, a task per few replicates.
    ``schema``: the parameters' columns.
    """
    import json

    jobs = spark.createDataFrame([(json.dumps(p, sort_keys=True), seed + i) for p in grid for i in range(reps)], "parameters string, seed long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(p, k, float(v)) for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, v in replicate(json.loads(p), s).items()]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["parameters", "metric", "value"])

    width = max(1, min(len(grid) * reps, spark.sparkContext.defaultParallelism * 4))
    values = jobs.repartition(width).mapInArrow(run, "parameters string, metric string, value double")
    got = percentile_interval(values, "value", ["parameters", "metric"], alpha)
    return got.withColumn("p_", F.from_json("parameters", schema)).select("p_.*", "metric", "point", "mean", "ci_lo", "ci_hi", "n_reps")
