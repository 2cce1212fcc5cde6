"""Classification metrics of two groups, from one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions.scalars import ratio
from paritas.operators.selection import group_rates


def group_outcomes(df: DataFrame, group: str = "group", label: str = "label", yhat: str = "yhat", proba: str = "proba", cells: Sequence[str] = ()) -> DataFrame:
    """Per cell and group (0, 1): size, rates of the confusion table, mean score, Brier score; null where undefined."""
    y, p, s = F.col(label), F.col(yhat), F.col(proba)
    n = lambda cond: F.count(F.when(cond, 1))
    got = df.where(F.col(group).isin(0, 1)).groupBy(*cells, F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y.cast("double")).alias("base_rate"), F.avg(p.cast("double")).alias("selection_rate"), F.avg(s).alias("mean_score"),
        n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"), n((y == 0) & (p == 0)).alias("tn"), n((y == 1) & (p == 0)).alias("fn"),
        F.avg((s - y) * (s - y)).alias("brier_score"),
    )
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return got.select(
        *cells, "grp", "n", "base_rate", "selection_rate", "mean_score", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"), ratio(tn, tn + fp).alias("tnr"),
        ratio(tp, tp + fp).alias("precision"), ratio(tn, tn + fn).alias("negative_predictive_value"), "brier_score",
    )


def disparities(outcomes: DataFrame, cells: Sequence[str] = ()) -> DataFrame:
    """Eight contrasts of group 0 against group 1, one row per cell."""
    names = ("selection_rate", "tpr", "fpr", "precision", "mean_score", "brier_score")
    side = lambda name, g: F.max(F.when(F.col("grp") == g, F.col(name))).alias(f"{name}_{g}")
    wide = outcomes.groupBy(*cells).agg(*(side(x, g) for x in names for g in (0, 1)))
    diff = lambda x: F.col(f"{x}_0") - F.col(f"{x}_1")
    return wide.select(
        *cells, ratio(F.col("selection_rate_0"), F.col("selection_rate_1")).alias("selection_rate_ratio"), diff("selection_rate").alias("selection_rate_difference"),
        diff("tpr").alias("tpr_difference"), diff("fpr").alias("fpr_difference"), diff("precision").alias("precision_difference"),
        ratio(F.col("precision_0"), F.col("precision_1")).alias("predictive_parity_ratio"), diff("mean_score").alias("mean_score_difference"), diff("brier_score").alias("brier_difference"),
    )


def classification_metrics(df: DataFrame, group: str = "group", label: str = "label", yhat: str = "yhat", cells: Sequence[str] = ()) -> DataFrame:
    """Ratio and difference of selection rates, differences of true and false positive rates, rates, accuracy."""
    g0, g1, y, p = F.col(group) == 0, F.col(group) == 1, F.col(label), F.col(yhat).cast("double")
    got = df.groupBy(*cells).agg(
        F.avg(F.when(g0, p)).alias("selection_rate_group0"), F.avg(F.when(g1, p)).alias("selection_rate_group1"),
        (F.avg(F.when(g0 & (y == 1), p)) - F.avg(F.when(g1 & (y == 1), p))).alias("equal_opportunity_difference"),
        (F.avg(F.when(g0 & (y == 0), p)) - F.avg(F.when(g1 & (y == 0), p))).alias("false_positive_rate_difference"),
        F.avg((y == F.col(yhat)).cast("double")).alias("accuracy"),
    )
    a, b = F.col("selection_rate_group0"), F.col("selection_rate_group1")
    return got.select(*cells, ratio(a, b).alias("disparate_impact"), (a - b).alias("statistical_parity_difference"), "equal_opportunity_difference", "false_positive_rate_difference", "selection_rate_group0", "selection_rate_group1", "accuracy")


def proxy_audit(df: DataFrame, features: Sequence[str], group: str = "group") -> DataFrame:
    """How far each feature stands for the group: means, difference, standardised difference, correlation."""
    rows = df.where(F.col(group).isin(0, 1))
    long = rows.unpivot([group], list(features), "feature", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    g = F.col(group).cast("double")
    got = long.groupBy("feature").agg(
        F.avg(F.when(F.col(group) == 0, F.col("x"))).alias("mean_group0"), F.avg(F.when(F.col(group) == 1, F.col("x"))).alias("mean_group1"),
        F.stddev_samp("x").alias("sd"), F.covar_pop("x", g).alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop(g).alias("sg"),
    )
    diff = F.col("mean_group0") - F.col("mean_group1")
    return got.select("feature", "mean_group0", "mean_group1", diff.alias("mean_difference"), ratio(diff, F.col("sd")).alias("standardized_mean_difference"), ratio(F.col("cov"), F.col("sx") * F.col("sg")).alias("pearson_corr_with_group"))


def flips(df: DataFrame, group: str = "group", before: str = "yhat", after: str = "cf_yhat") -> DataFrame:
    """Changes between two decisions, overall and for each group, in one pass."""
    a, b = F.col(before), F.col(after)
    rate = lambda cond: F.avg(cond.cast("double"))
    rolled = df.rollup(F.col(group)).agg(
        F.grouping(group).alias("all_"), F.count(F.lit(1)).alias("n"), rate(a != b).alias("flip_rate"), rate((a == 0) & (b == 1)).alias("reject_to_invite_rate"), rate((a == 1) & (b == 0)).alias("invite_to_reject_rate")
    )
    part = F.when(F.col("all_") == 1, "overall").otherwise(F.concat(F.lit("group_"), F.col(group).cast("string")))
    return rolled.where((F.col("all_") == 1) | F.col(group).isin(0, 1)).select(part.alias("part"), "n", "flip_rate", "reject_to_invite_rate", "invite_to_reject_rate")


def model_suite(metrics: DataFrame) -> DataFrame:
    """One row per model from rows (model, stage, disparate_impact, equal_opportunity_difference, accuracy)."""
    stages = (("baseline", "baseline"), ("counterfactual_fixed_threshold", "cf_fixed"), ("counterfactual_rethresholded", "rethresh"))
    names = ("disparate_impact", "equal_opportunity_difference", "accuracy")
    return metrics.groupBy("model").agg(*(F.max(F.when(F.col("stage") == stage, F.col(x))).alias(f"{short}_{x}") for x in names for stage, short in stages))


def percentile_interval(df: DataFrame, value: str, cells: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Median, mean, exact percentile interval and number of the defined values; mean is always there."""
    x = F.nanvl(F.col(value), F.lit(None).cast("double"))
    q = df.groupBy(*cells).agg(F.percentile(x, F.array(F.lit(0.5), F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.avg(x).alias("mean"), F.count(x).alias("n_reps"))
    return q.select(*cells, F.get("q", F.lit(0)).alias("point"), "mean", F.get("q", F.lit(1)).alias("ci_lo"), F.get("q", F.lit(2)).alias("ci_hi"), "n_reps")


def impact(df: DataFrame, group: str, yhat: str, cells: Sequence[str] = ()) -> DataFrame:
    return group_rates(df, group, yhat, cells)


def multiple_comparisons(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg decisions over all rows (a table of results: one row per cell)."""
    from pyspark.sql import Window

    every = Window.orderBy(F.col(p).asc_nulls_last())
    k = F.count(p).over(Window.partitionBy())
    rows = df.withColumn("rank", F.rank().over(every).cast("long")).withColumn("n_tests", k)
    ok = F.col(p) <= alpha * F.col("rank") / F.col("n_tests")
    last = F.max(F.when(ok, F.col("rank"))).over(Window.partitionBy())
    return rows.withColumn("bonferroni", F.col(p) <= alpha / F.col("n_tests")).withColumn("bh", F.coalesce(F.col("rank") <= last, F.lit(False)) & F.col(p).isNotNull())
