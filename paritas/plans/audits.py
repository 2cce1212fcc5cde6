"""Audits over many score columns and axes at once.

Scores and axes become rows, so all cells share one plan: one selection per score column, one aggregation per
(score column, axis), however many cells there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions.scalars import decomposition_label, finite, group_of
from paritas.operators import inference, selection
from paritas.operators.documents import distance_levels, distance_means, gap_table, rank_lowest, sections
from paritas.operators.selection import DEFAULT_AXES

CELL = ("score_col", "axis")


def _long_scores(df: DataFrame, scores: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., score_col, score); score columns that are missing are skipped."""
    there = [c for c in scores if c in df.columns]
    return df.select(*keep, *(finite(F.col(c)).alias(c) for c in there)).unpivot(list(keep), there, "score_col", "score")


def _long_axes(df: DataFrame, axes: Mapping[str, str], config: Mapping[str, dict]) -> DataFrame:
    """``df`` once per axis, with ``axis`` and ``grp``; axes without a configuration are skipped."""
    pairs = [F.struct(F.lit(a).alias("axis"), group_of(F.col(c), config[a]).alias("grp")) for a, c in axes.items() if a in config]
    out = df.withColumn("ax_", F.explode(F.array(*pairs)))
    return out.drop(*set(axes.values())).select("*", "ax_.axis", "ax_.grp").drop("ax_")


def _labels(df: DataFrame, config: Mapping[str, dict]) -> DataFrame:
    for side in (0, 1):
        name = F.lit(None).cast("string")
        for axis, c in config.items():
            name = F.when(F.col("axis") == axis, c[f"group_{side}_label"]).otherwise(name)
        df = df.withColumn(f"group_{side}_label", name)
    return df


def cells(df: DataFrame, scores: Sequence[str], axes: Mapping[str, str], keys: Sequence[str], config: Mapping[str, dict] = DEFAULT_AXES) -> DataFrame:
    """Rows (keys, score_col, score, axis, grp) of all cells."""
    return _long_axes(_long_scores(df, scores, [*keys, *dict.fromkeys(axes.values())]), axes, config)


def axis_audit(
    df: DataFrame, scores: Sequence[str], axes: Mapping[str, str], keys: Sequence[str], fraction: float = 0.2, config: Mapping[str, dict] = DEFAULT_AXES,
    n_bootstrap: int = 0, permutations: bool = False, seed: int = 0,
) -> DataFrame:
    """Per score column and axis: sizes, selection rates, ratio, difference, and on request intervals and exact p-values.

    The selection is over all rows; rows in neither group of an axis are then left out of its rates.
    """
    long = _long_scores(df, scores, [*keys, *dict.fromkeys(axes.values())])
    chosen = _long_axes(selection.top_k(long, "score", keys, fraction, ["score_col"], seed), axes, config)
    out = _labels(selection.group_rates(chosen, "grp", "selected", CELL), config)
    if n_bootstrap:
        boot = axis_bootstrap(df, scores, axes, keys, fraction, n_bootstrap, config, seed)
        out = out.join(boot.select(*CELL, *(F.col(c).alias(f"bootstrap_di_{c}" if c != "n_reps" else "bootstrap_n_reps") for c in ("point", "ci_lo", "ci_hi", "n_reps"))), list(CELL), "left")
    if permutations:
        perm = axis_permutation(df, scores, axes, keys, fraction, config, seed)
        out = out.join(perm.select(*CELL, F.col("p_value").alias("permutation_p_value")), list(CELL), "left")
    return out


def axis_bootstrap(df: DataFrame, scores: Sequence[str], axes: Mapping[str, str], keys: Sequence[str], fraction: float, reps: int, config: Mapping[str, dict] = DEFAULT_AXES, seed: int = 0, stratified: bool = True) -> DataFrame:
    """Bootstrap intervals of all cells in one job, from scores that are at hand."""
    return inference.bootstrap_di(cells(df, scores, axes, keys, config), "score", "grp", keys, fraction, reps, seed, 0.05, stratified, CELL)


def axis_permutation(df: DataFrame, scores: Sequence[str], axes: Mapping[str, str], keys: Sequence[str], fraction: float, config: Mapping[str, dict] = DEFAULT_AXES, seed: int = 0) -> DataFrame:
    """Exact permutation tests of all cells in one job."""
    return inference.permutation_exact(cells(df, scores, axes, keys, config), "score", "grp", keys, fraction, CELL, seed)


def mitigation_effect(df: DataFrame, before: str, after: str, axes: Mapping[str, str], keys: Sequence[str], fraction: float = 0.2, config: Mapping[str, dict] = DEFAULT_AXES) -> DataFrame:
    """Per axis: the ratio before and after, and the change."""
    rows = axis_audit(df, (before, after), axes, keys, fraction, config)
    side = lambda name: F.max(F.when(F.col("score_col") == name, F.col("disparate_impact")))
    got = rows.groupBy("axis").agg(side(before).alias("baseline_di"), side(after).alias("mitigated_di"))
    return got.withColumn("delta_di", F.col("mitigated_di") - F.col("baseline_di"))


def paired_cells(df: DataFrame, pairs: Mapping[str, tuple[str, str]], axes: Mapping[str, str], keys: Sequence[str], config: Mapping[str, dict] = DEFAULT_AXES) -> DataFrame:
    """Rows (keys, score_col, before, after, axis, grp) of pairs of score columns; pairs with a missing column are skipped."""
    some = [F.struct(F.lit(name).alias("score_col"), finite(F.col(a)).alias("before"), finite(F.col(b)).alias("after")) for name, (a, b) in pairs.items() if {a, b} <= set(df.columns)]
    rows = df.select(*keys, *dict.fromkeys(axes.values()), F.explode(F.array(*some)).alias("x_"))
    return _long_axes(rows.select("*", "x_.*").drop("x_"), axes, config)


def decomposition(
    df: DataFrame, questions: Sequence[str], axes: Mapping[str, str], keys: Sequence[str], fraction: float = 0.3, config: Mapping[str, dict] = DEFAULT_AXES,
    n_bootstrap: int = 0, n_permutations: int = 0, seed: int = 0,
) -> DataFrame:
    """Per question and axis: the ratios of ``<question>_original`` and ``<question>_stripped``, and what drives the first.

    With ``n_bootstrap``: an interval of each stage's ratio; with ``n_permutations``: the paired test of the change.
    """
    stages = ("original", "stripped")
    names = [f"{q}_{s}" for q in questions for s in stages]
    rows = axis_audit(df, names, axes, keys, fraction, config)
    stage, question = F.regexp_extract("score_col", "(original|stripped)$", 1), F.regexp_replace("score_col", "_(original|stripped)$", "")
    rows = rows.select(question.alias("question"), stage.alias("stage"), "axis", "disparate_impact")
    side = lambda s: F.max(F.when(F.col("stage") == s, F.col("disparate_impact")))
    got = rows.groupBy("question", "axis").agg(side("original").alias("original_di"), side("stripped").alias("stripped_di"))
    got = got.withColumn("delta_di", F.col("stripped_di") - F.col("original_di")).withColumn("label", decomposition_label(F.col("original_di"), F.col("stripped_di")))
    if n_bootstrap:
        drawn = axis_bootstrap(df, names, axes, keys, fraction, n_bootstrap, config, seed=seed)
        ends = [F.max(F.when(stage == s, F.col(end))).alias(f"{s}_{end}") for s in stages for end in ("ci_lo", "ci_hi")]
        got = got.join(drawn.groupBy(question.alias("question"), "axis").agg(*ends), ["question", "axis"], "left")
    if n_permutations:
        long = paired_cells(df, {q: (f"{q}_original", f"{q}_stripped") for q in questions}, axes, keys, config)
        tested = inference.paired_permutation(long, "before", "after", "grp", keys, fraction, n_permutations, seed, ["score_col", "axis"])
        got = got.join(tested.select(F.col("score_col").alias("question"), "axis", F.col("delta_observed").alias("paired_delta"), "p_value", "n_perms_valid"), ["question", "axis"], "left")
    return got


def content_equivalence(df: DataFrame, key: str, seed: str, stratum: str, vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Distances by level (with percentiles, over all pairs), and the ratio of their means (without pairs)."""
    return distance_levels(df, key, seed, stratum, vec), equivalence_ratio(df, key, seed, stratum, vec)


def equivalence_ratio(df: DataFrame, key: str, seed: str, stratum: str, vec: str = "vec") -> DataFrame:
    from paritas.functions.scalars import equivalence_verdict

    means = distance_means(df, key, seed, stratum, vec)
    side = lambda name: F.max(F.when(F.col("level") == name, F.col("mean")))
    got = means.agg(side("within_seed_across_stratum").alias("within"), side("across_seed").alias("across"))
    r = F.try_divide(F.col("within"), F.col("across"))
    return got.select("within", "across", r.alias("ratio"), (F.col("within") < F.col("across")).alias("holds"), equivalence_verdict(r).alias("verdict"))


def paragraph_audit(df: DataFrame, key: str, text: str, instruments: Mapping, min_words: int = 50, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of all sections of ``min_words`` words or more, and the lowest section per instrument. ``instruments``: name to column function of a text."""
    rows = sections(df, key, text, pattern).withColumn("scored", F.col("word_count") >= min_words)
    rows = rows.select("*", *(F.when(F.col("scored"), f(F.col("body"))).alias(name) for name, f in instruments.items())).drop("body")
    long = rows.where("scored").unpivot([key, "pos", "label"], list(instruments), "instrument", "score")
    return rows, rank_lowest(long, key, len(instruments))


def dilution(excerpts: DataFrame, skeleton: str, pairs: DataFrame, instruments: Mapping) -> DataFrame:
    """Gaps of excerpts and of documents that hold them. ``excerpts``: rows (variant, text)."""
    from paritas.functions.texts import fill_template

    both = excerpts.select("variant", F.lit("excerpt").alias("level"), "text").unionByName(excerpts.select("variant", F.lit("full_doc").alias("level"), fill_template(F.lit(skeleton), F.col("text")).alias("text")))
    scored = both.select("variant", "level", *(f(F.col("text")).alias(name) for name, f in instruments.items()))
    return gap_table(scored.unpivot(["variant", "level"], list(instruments), "instrument", "compound"), pairs)


def heatmap(audit: DataFrame, value: str = "disparate_impact", scores: Sequence[str] | None = None, axes: Sequence[str] | None = None) -> DataFrame:
    """One row per score column, one column per axis."""
    grouped = audit.groupBy("score_col")
    return (grouped.pivot("axis", list(axes)) if axes else grouped.pivot("axis")).agg(F.first(value))


def slopes(decomposed: DataFrame) -> DataFrame:
    """Rows (question, axis, stage, position, disparate_impact): both ends of each line of a slope figure."""
    return decomposed.unpivot(["question", "axis"], ["original_di", "stripped_di"], "stage", "disparate_impact").withColumn("position", F.when(F.col("stage") == "original_di", 0).otherwise(1))


def bars(audit: DataFrame) -> DataFrame:
    """Rows (score_col, axis, group, selection_rate, disparate_impact, passes): what a bar figure shows; passes within [0.8, 1.25]."""
    from paritas.functions.scalars import four_fifths

    long = audit.unpivot([*CELL, "disparate_impact"], ["selection_rate_group0", "selection_rate_group1"], "side", "selection_rate")
    return long.select(*CELL, F.regexp_extract("side", "(group.)$", 1).alias("group"), "selection_rate", "disparate_impact", four_fifths(F.col("disparate_impact"), True).alias("passes"))


def forest(intervals: DataFrame, label: str) -> DataFrame:
    """Rows (position, label, point, ci_lo, ci_hi), the smallest ratio first: a table of a few results."""
    from pyspark.sql import Window

    return intervals.select(F.row_number().over(Window.orderBy(F.col("point").asc_nulls_last(), label)).alias("position"), label, "point", "ci_lo", "ci_hi")


def section_lines(scored: DataFrame, key: str, instruments: Sequence[str]) -> DataFrame:
    """Rows (document, pos, label, instrument, score) of scored sections, for a line figure."""
    return scored.where("scored").unpivot([key, "pos", "label"], list(instruments), "instrument", "score")


def confirmatory_test(df: DataFrame, score, axis: str = "school_tier", fraction: float = 0.3, config: Mapping[str, dict] = DEFAULT_AXES, key: str = "applicant_id", text: str = "text") -> DataFrame:
    """The registered test: school names by tier placeholders, new scores, the ratio with its exact p-value, and the decision.

    ``score``: a column function of a text.
    """
    from paritas.functions.scalars import prereg_decision
    from paritas.functions.texts import tier_substitution

    rows = df.select(key, F.col(f"stratum_{axis}").alias("tier"), tier_substitution(F.col(text), F.col("stratum_school_tier")).alias("t"))
    rows = rows.select(key, "tier", score(F.col("t")).alias("score"))
    got = axis_permutation(rows, ["score"], {axis: "tier"}, [key], fraction, config)
    return got.select("axis", "n0", "n1", "k", "observed_di", "p_value", prereg_decision(F.col("observed_di"), F.col("p_value")).alias("decision"))
