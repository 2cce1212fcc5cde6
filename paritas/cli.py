"""Command lines of the audits: ``python -m paritas.cli COMMAND --help``. Results go to a JSON report and, where asked, CSV."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions import texts
from paritas.operators import documents, inference
from paritas.operators import simulation as sim
from paritas.operators.selection import DEFAULT_AXES
from paritas.plans import audits, simulations
from paritas.sources import corpora

AXES = {axis: f"stratum_{axis}" for axis in DEFAULT_AXES}
ID = ["applicant_id"]


def _session() -> SparkSession:
    return SparkSession.builder.appName("paritas").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _scorer(spec: str):
    return corpora.score_column(corpora.load_scorer(spec))


def mitigator(a) -> None:
    """Audit 1: scores of raw and of neutralised texts, their ratios and a paired test of all axes in one job."""
    spark = _session()
    score = _scorer(a.pipeline)
    rows = corpora.read_corpus(spark, a.corpus)
    rows = rows.withColumn("score_baseline", score("text")).withColumn("score_mitigated", score(texts.mitigate(F.col("text")))).cache()
    both = audits.axis_audit(rows, ["score_baseline", "score_mitigated"], AXES, ID, a.top_frac, n_bootstrap=a.bootstrap_reps, seed=a.seed)
    effect = audits.mitigation_effect(rows, "score_baseline", "score_mitigated", AXES, ID, a.top_frac)
    report = {"axes": both, "effect": effect}
    if a.n_permutations:
        pairs = audits.paired_cells(rows, {"score": ("score_baseline", "score_mitigated")}, AXES, ID)
        paired = inference.paired_permutation(pairs, "before", "after", "grp", ID, a.top_frac, a.n_permutations, a.seed, ["axis"]).cache()
        report |= {f"paired_{axis}": paired.where(F.col("axis") == axis).drop("axis") for axis in AXES}
    corpora.write_scores(rows, f"{a.out_dir}/scores")
    corpora.write_report(report, f"{a.out_dir}/audit_1.json")


def questions(a) -> None:
    """Audit 2: question scores of texts by a given extractor, audited on all axes."""
    spark = _session()
    rows = corpora.read_corpus(spark, a.corpus)
    answers = corpora.call_model(rows, "text", corpora.load_scorer(a.extractor), "applicant_id")
    scored = answers.select("applicant_id", *texts.parse_answers(F.col("content"), documents.QUESTIONS))
    total = sum((F.coalesce(F.col(q) * F.col(q), F.lit(0.0)) for q in documents.QUESTIONS), F.lit(0.0))
    rows = rows.join(scored.withColumn("_total", total), "applicant_id", "left").cache()
    names = [*documents.QUESTIONS, "_total"]
    got = audits.axis_audit(rows, names, AXES, ID, a.top_frac, n_bootstrap=a.bootstrap_reps, permutations=True, seed=a.seed)
    means = audits.cells(rows, names, AXES, [*ID, "seed_key"]).groupBy("seed_key", "score_col", "axis", "grp").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    corpora.write_scores(rows, f"{a.out_dir}/scores")
    corpora.write_report({"results_per_score_col": got, "heatmap": audits.heatmap(got), "within_seed_means": means}, f"{a.out_dir}/audit_2.json")


def rebootstrap(a) -> None:
    """Intervals and tests from scores that are at hand."""
    rows = corpora.read_scores(_session(), a.scores)
    got = audits.axis_audit(rows, a.score_cols, AXES, ID, a.top_frac, n_bootstrap=a.bootstrap_reps, permutations=a.n_permutations > 0, seed=a.seed)
    corpora.write_report({"results_per_score_col": got}, a.out)


def decomposition(a) -> None:
    """Original against stripped scores, joined by applicant."""
    spark = _session()
    base = corpora.read_corpus(spark, a.corpus)
    for name, path in (("original", a.original_scores), ("stripped", a.stripped_scores)):
        scores = corpora.read_scores(spark, path)
        base = base.join(scores.select("applicant_id", *(F.col(q).alias(f"{q}_{name}") for q in (*documents.QUESTIONS, "_total"))), "applicant_id", "left")
    got = audits.decomposition(base, [*documents.QUESTIONS, "_total"], AXES, ID, a.top_frac, n_bootstrap=a.bootstrap_reps, n_permutations=a.n_permutations, seed=a.seed)
    corpora.write_report({"cells": got, "slopes": audits.slopes(got)}, f"{a.out_dir}/decomposition.json")


def equivalence(a) -> None:
    """Distances within and across seeds and strata, from a table with vectors."""
    rows = _session().read.parquet(a.vectors)
    levels, verdict = audits.content_equivalence(rows, "applicant_id", "seed_key", "stratum_key", "vec")
    pairs = documents.pair_distances(rows, "applicant_id", "seed_key", "stratum_key", "vec", within_seed=True)
    corpora.write_report({"overall": levels, "per_seed": documents.summarise(pairs, "distance", ["seed", "level"]), "decision": verdict}, a.out)


def paragraphs(a) -> None:
    """Sections of documents, scored by each instrument; the lowest one."""
    df = corpora.read_documents(_session(), a.document)
    rows, low = audits.paragraph_audit(df, "path", "text", {i: _scorer(i) for i in a.instruments}, a.min_words, a.section_regex)
    corpora.write_report({"sections": rows, "lowest": low}, a.out)


def dilution(a) -> None:
    """Gaps of excerpts against whole documents."""
    spark = _session()
    config = corpora.read_dilution_config(spark, a.config)
    excerpts = spark.createDataFrame(list(config["variants"].items()), "variant string, text string")
    pairs = spark.createDataFrame(config["pairs"], "low string, high string")
    gaps = audits.dilution(excerpts, config["skeleton"], pairs, {i: _scorer(i) for i in a.instruments})
    corpora.write_report({"gaps": gaps, "dilution": documents.dilution_percent(gaps)}, f"{a.out_dir}/dilution.json")


def _anchorings(spark: SparkSession, a) -> list[tuple]:
    if a.anchorings:
        return [tuple(r) for r in corpora.read_anchorings(spark, a.anchorings, bare_list=True).collect()]
    return [sim.parse_anchoring(a.anchoring)] if a.anchoring else list(sim.ANCHORINGS)


def simulate(a) -> None:
    """Seven metrics per anchoring over simulated replicates."""
    spark = _session()
    got = simulations.screening(spark, _anchorings(spark, a), a.n, a.invite_rate, a.sd, a.reps, a.seed, a.model)
    corpora.write_report({"metrics": got}, a.out)


def counterfactual(a) -> None:
    """Baseline against redrawn sentiment, per anchoring and model."""
    spark = _session()
    got: DataFrame | None = None
    for model in a.models:
        part = simulations.counterfactual(spark, _anchorings(spark, a), a.n, a.invite_rate, a.narrative_sd, a.reps, a.seed, model).withColumn("model", F.lit(model))
        got = part if got is None else got.unionByName(part)
    corpora.write_report({"stages": got, "bars": simulations.model_bars(got)}, a.out)


def disclosure(a) -> None:
    """The ratio by the share of applicants of group 0 that disclose."""
    got = simulations.disclosure_sweep(_session(), sim.parse_anchoring(a.anchoring), a.rates, a.n, a.invite_rate, a.sd, a.reps, a.seed, a.model)
    corpora.write_report({"rates": got.orderBy("rate")}, a.out)


def corpus(a) -> None:
    """A grid of applicants with texts by a given writer."""
    spark = _session()
    grid = sim.corpus_grid(spark, a.seeds, a.races, a.genders, a.tiers, a.instances_per_cell)
    if a.dry_run:
        print(grid.count())
        return
    prompts = grid.withColumn("prompt", F.concat_ws(" | ", "seed_key", "race", "gender", "school_tier", F.col("instance").cast("string")))
    text = corpora.call_model(prompts, "prompt", corpora.load_scorer(a.writer), "applicant_id", to="text")
    rows = grid.join(text, "applicant_id").select("applicant_id", "seed_key", F.struct("race", "gender", "school_tier").alias("stratum"), "instance", "text")
    print(corpora.write_corpus(rows, a.out))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paritas")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *required: str, **options):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        for name in required:
            p.add_argument(f"--{name}", required=True)
        for name, default in options.items():
            many = isinstance(default, (list, tuple))
            kind = type(default[0]) if many else type(default) if default is not None else str
            flag = f"--{name.replace('_', '-')}"
            if kind is bool:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, type=kind, default=default, nargs="+" if many else None)
        p.set_defaults(run=f)

    command(mitigator, "corpus", "pipeline", "out-dir", top_frac=0.2, bootstrap_reps=200, n_permutations=10_000, seed=0)
    command(questions, "corpus", "extractor", "out-dir", top_frac=0.3, bootstrap_reps=200, seed=0)
    command(rebootstrap, "scores", "out", score_cols=["_total"], top_frac=0.3, bootstrap_reps=1000, n_permutations=0, seed=0)
    command(decomposition, "corpus", "original-scores", "stripped-scores", "out-dir", top_frac=0.3, bootstrap_reps=1000, n_permutations=10_000, seed=0)
    command(equivalence, "vectors", "out")
    command(paragraphs, "document", "out", "instruments", section_regex=None, min_words=50)
    command(dilution, "config", "out-dir", "instruments")
    command(simulate, "out", anchorings=None, anchoring=None, n=6000, invite_rate=0.30, sd=0.30, reps=1000, seed=42, model="logistic_regression")
    command(counterfactual, "out", anchorings=None, anchoring=None, n=6000, invite_rate=0.12, narrative_sd=0.10, reps=100, seed=0, models=["logistic_regression"])
    command(disclosure, "anchoring", "out", rates=list(sim.DISCLOSURE_RATES), n=6000, invite_rate=0.12, sd=0.3, reps=100, seed=0, model="logistic_regression")
    command(corpus, "out", writer=None, instances_per_cell=2, dry_run=False, seeds=["control_neutral", "poverty_signal", "illness_signal", "immigration_signal"], races=["White", "Black", "Hispanic/Latino", "Asian"], genders=["Female", "Male"], tiers=["top_20", "mid_tier", "lower_tier"])
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if isinstance(getattr(a, "instruments", None), str):
        a.instruments = a.instruments.split(",")
    try:
        a.run(a)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
