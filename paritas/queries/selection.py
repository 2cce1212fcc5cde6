"""Selection, disparate impact and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.scalars import decomposition_label, equivalence_verdict, four_fifths, prereg_decision, rounded
from paritas.operators import metrics, selection
from paritas.queries.roles import APPLICANTS, EVALUATED, LINES, RATES, applicants, evaluated, lines, sel, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(df: DataFrame, *skip: str) -> DataFrame:
    """Doubles to six digits."""
    return df.select(*(rounded(F.col(c)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


@query(f"WITH {APPLICANTS} SELECT id, segment, grp FROM a")
def binary_group_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).select("id", "segment", "grp")


@query(f"WITH {APPLICANTS}, {sel('a', 0.2)} SELECT id, score, grp, selected FROM s")
def topk_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k(applicants(spark, sf_dir), "score", ["id"], 0.2).select("id", "score", "grp", "selected")


@query(f"WITH {LINES}, {sel('l', 0.3, cells='l_linestatus')} SELECT l_linestatus, l_returnflag, count(*) AS n, sum(selected)::BIGINT AS n_selected FROM s GROUP BY ALL")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = selection.top_k(lines(spark, sf_dir), "score", ["id"], 0.3, ["l_linestatus"])
    return got.groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("selected").cast("long").alias("n_selected"))


@query(f"WITH {APPLICANTS}, {sel('a', 0.0, least=0)}, {sel('a', 0.0, least=1, name='u')} SELECT s.id, s.selected AS selected_0, u.selected AS selected_1 FROM s JOIN u USING (id)")
def topk_min_k_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applicants(spark, sf_dir)
    a = selection.top_k(rows, "score", ["id"], 0.0, min_k=0, to="selected_0").select("id", "selected_0")
    return a.join(selection.top_k(rows, "score", ["id"], 0.0, to="selected_1").select("id", "selected_1"), "id")


_DI = f"WITH {APPLICANTS}, {sel('a', 0.2)}, r AS (SELECT {RATES} FROM s)"


@query(f"{_DI} SELECT n_group0, n_group1, round(r0, 6) AS selection_rate_group0, round(r1, 6) AS selection_rate_group1, round(r0 / nullif(r1, 0), 6) AS disparate_impact, round(r0 - r1, 6) + 0.0 AS statistical_parity_difference FROM r")
def disparate_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(selection.disparate_impact(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2))


@query(f"""WITH {APPLICANTS}, {sel('a', 0.2)}, r AS (SELECT nation, {RATES} FROM s GROUP BY nation), d AS (SELECT nation, r0 / nullif(r1, 0) AS di FROM r)
SELECT nation, round(di, 6) AS disparate_impact, di >= 0.8 AS passes, di >= 0.8 AND di <= 1.25 AS passes_symmetric FROM d""")
def four_fifths_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.group_rates(selection.top_k(applicants(spark, sf_dir), "score", ["id"], 0.2), "grp", "selected", ["nation"])
    di = F.col("disparate_impact")
    return rows.select("nation", rounded(di).alias("disparate_impact"), four_fifths(di).alias("passes"), four_fifths(di, True).alias("passes_symmetric"))


@query(f"WITH {APPLICANTS}, {sel('a', 0.2, cells='nation')}, r AS (SELECT nation, {RATES} FROM s GROUP BY nation) SELECT nation, n_group0, n_group1, round(r0 - r1, 6) + 0.0 AS statistical_parity_difference FROM r")
def statistical_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = selection.disparate_impact(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2, ["nation"])
    return r6(got).select("nation", "n_group0", "n_group1", "statistical_parity_difference")


_OUT = f"""WITH {EVALUATED}, c AS (SELECT grp, count(*) AS n, avg(label::DOUBLE) AS base_rate, avg(yhat::DOUBLE) AS selection_rate, avg(proba) AS mean_score,
  sum(CASE WHEN label = 1 AND yhat = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN label = 0 AND yhat = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN label = 0 AND yhat = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN label = 1 AND yhat = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS fn,
  avg((proba - label) * (proba - label)) AS brier_score FROM e GROUP BY grp),
o AS (SELECT grp, n, base_rate, selection_rate, mean_score, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr, tn / nullif(tn + fp, 0) AS tnr,
  tp / nullif(tp + fp, 0) AS precision, tn / nullif(tn + fn, 0) AS negative_predictive_value, brier_score FROM c)"""


@query(f"{_OUT} SELECT grp, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('base_rate', 'selection_rate', 'mean_score', 'tpr', 'fpr', 'fnr', 'tnr', 'precision', 'negative_predictive_value', 'brier_score'))} FROM o")
def group_outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.group_outcomes(evaluated(spark, sf_dir)))


@query(f"""{_OUT} SELECT round(a.selection_rate / nullif(b.selection_rate, 0), 6) AS selection_rate_ratio, round(a.selection_rate - b.selection_rate, 6) + 0.0 AS selection_rate_difference,
  round(a.tpr - b.tpr, 6) + 0.0 AS tpr_difference, round(a.fpr - b.fpr, 6) + 0.0 AS fpr_difference, round(a.precision - b.precision, 6) + 0.0 AS precision_difference,
  round(a.precision / nullif(b.precision, 0), 6) AS predictive_parity_ratio, round(a.mean_score - b.mean_score, 6) + 0.0 AS mean_score_difference, round(a.brier_score - b.brier_score, 6) + 0.0 AS brier_difference
  FROM o a, o b WHERE a.grp = 0 AND b.grp = 1""")
def disparity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.disparities(metrics.group_outcomes(evaluated(spark, sf_dir))))


_CM = """avg(CASE WHEN grp = 0 THEN {y}::DOUBLE END) AS r0, avg(CASE WHEN grp = 1 THEN {y}::DOUBLE END) AS r1,
  avg(CASE WHEN grp = 0 AND label = 1 THEN {y}::DOUBLE END) - avg(CASE WHEN grp = 1 AND label = 1 THEN {y}::DOUBLE END) AS eod,
  avg(CASE WHEN grp = 0 AND label = 0 THEN {y}::DOUBLE END) - avg(CASE WHEN grp = 1 AND label = 0 THEN {y}::DOUBLE END) AS fprd, avg(CASE WHEN label = {y} THEN 1.0::DOUBLE ELSE 0 END) AS acc"""


@query(f"""WITH {EVALUATED}, m AS (SELECT {_CM.format(y='yhat')} FROM e) SELECT round(r0 / nullif(r1, 0), 6) AS disparate_impact, round(r0 - r1, 6) + 0.0 AS statistical_parity_difference,
  round(eod, 6) + 0.0 AS equal_opportunity_difference, round(fprd, 6) + 0.0 AS false_positive_rate_difference, round(r0, 6) AS selection_rate_group0, round(r1, 6) AS selection_rate_group1, round(acc, 6) AS accuracy FROM m""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.classification_metrics(evaluated(spark, sf_dir)))


SWEEP = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)


@query(f"""WITH {EVALUATED}, k AS (SELECT *, row_number() OVER (ORDER BY proba DESC NULLS LAST, md5('0:' || id::VARCHAR)) AS rk, count(*) OVER () AS n FROM e),
r AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in SWEEP)}]) AS rate),
x AS (SELECT rate, grp, proba, CASE WHEN rk <= round_even(rate * n, 0) THEN 1 ELSE 0 END AS s FROM k, r),
y AS (SELECT rate, coalesce(min(CASE WHEN s = 1 THEN proba END), 'inf'::DOUBLE) AS t, avg(CASE WHEN grp = 0 THEN s::DOUBLE END) AS r0, avg(CASE WHEN grp = 1 THEN s::DOUBLE END) AS r1 FROM x GROUP BY rate)
SELECT rate, round(CASE WHEN isinf(t) THEN NULL ELSE t END, 6) AS threshold, isinf(t) AS nothing_selected, round(r0, 6) AS selection_rate_group0, round(r1, 6) AS selection_rate_group1,
  round(r0 / nullif(r1, 0), 6) AS disparate_impact, round(r0 - r1, 6) + 0.0 AS statistical_parity_difference FROM y""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = selection.threshold_sweep(evaluated(spark, sf_dir), "proba", "group", ["id"], SWEEP)
    none = F.col("threshold") == float("inf")
    return r6(got.select("rate", F.when(~none, F.col("threshold")).alias("threshold"), none.alias("nothing_selected"), "selection_rate_group0", "selection_rate_group1", "disparate_impact", "statistical_parity_difference"))


@query(f"""WITH {EVALUATED}, u AS (SELECT grp::DOUBLE AS g, grp, 'n_chars' AS feature, n_chars AS x FROM e UNION ALL SELECT grp::DOUBLE, grp, 'toxic', toxic FROM e UNION ALL SELECT grp::DOUBLE, grp, 'constant', 1.0::DOUBLE FROM e),
m AS (SELECT feature, avg(CASE WHEN grp = 0 THEN x END) AS m0, avg(CASE WHEN grp = 1 THEN x END) AS m1, stddev_samp(x) AS sd, covar_pop(x, g) AS cov, stddev_pop(x) AS sx, stddev_pop(g) AS sg FROM u GROUP BY feature)
SELECT feature, round(m0, 4) AS mean_group0, round(m1, 4) AS mean_group1, round(m0 - m1, 4) + 0.0 AS mean_difference, round((m0 - m1) / nullif(sd, 0), 6) + 0.0 AS standardized_mean_difference,
  round(cov / nullif(sx * sg, 0), 6) + 0.0 AS pearson_corr_with_group FROM m""")
def feature_proxy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.proxy_audit(evaluated(spark, sf_dir).withColumn("constant", F.lit(1.0)), ["n_chars", "toxic", "constant"])
    four = ("mean_group0", "mean_group1", "mean_difference")
    return got.select("feature", *(rounded(F.col(c), 4).alias(c) for c in four), *(rounded(F.col(c)).alias(c) for c in ("standardized_mean_difference", "pearson_corr_with_group")))


@query(f"""WITH {EVALUATED}, p AS (SELECT 'overall' AS part, * FROM e UNION ALL SELECT 'group_' || grp, * FROM e)
SELECT part, count(*) AS n, round(avg((yhat <> cf_yhat)::INT::DOUBLE), 6) AS flip_rate, round(avg((yhat = 0 AND cf_yhat = 1)::INT::DOUBLE), 6) AS reject_to_invite_rate, round(avg((yhat = 1 AND cf_yhat = 0)::INT::DOUBLE), 6) AS invite_to_reject_rate FROM p GROUP BY part""")
def counterfactual_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.flips(evaluated(spark, sf_dir)))


@query(f"""WITH {EVALUATED}, m AS (SELECT 'length' AS model, 'baseline' AS stage, {_CM.format(y='yhat')} FROM e UNION ALL SELECT 'length', 'cf', {_CM.format(y='cf_yhat')} FROM e)
SELECT model, {', '.join(f"round(max(CASE WHEN stage = '{s}' THEN {x} END), 6){z} AS {n}_{m}" for m, x, z in (('disparate_impact', 'r0 / nullif(r1, 0)', ''), ('equal_opportunity_difference', 'eod', ' + 0.0'), ('accuracy', 'acc', '')) for s, n in (('baseline', 'baseline'), ('cf', 'cf_fixed'), ('none', 'rethresh')))} FROM m GROUP BY model""")
def model_suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir)
    stage = lambda name, y: metrics.classification_metrics(rows, yhat=y).select(F.lit("length").alias("model"), F.lit(name).alias("stage"), "disparate_impact", "equal_opportunity_difference", "accuracy")
    return r6(metrics.model_suite(stage("baseline", "yhat").unionByName(stage("counterfactual_fixed_threshold", "cf_yhat"))))


@query("""SELECT c_mktsegment AS segment, round(quantile_cont(c_acctbal, 0.5), 6) AS point, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.025), 6) AS ci_lo, round(quantile_cont(c_acctbal, 0.975), 6) AS ci_hi, count(c_acctbal) AS n_reps FROM customer GROUP BY 1""")
def percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.percentile_interval(applicants(spark, sf_dir), "score", ["segment"])
    return got.select("segment", rounded(F.col("point")).alias("point"), rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("ci_lo")).alias("ci_lo"), rounded(F.col("ci_hi")).alias("ci_hi"), "n_reps")


_GRID = "g AS (SELECT o / 20.0::DOUBLE AS o, s / 20.0::DOUBLE AS s FROM (SELECT unnest(range(0, 41)) AS o), (SELECT unnest(range(0, 41)) AS s) UNION ALL SELECT NULL, 1.0)"


def _grid(spark: SparkSession) -> DataFrame:
    side = lambda n: spark.range(41).select((F.col("id") / 20.0).alias(n))
    return side("o").crossJoin(side("s")).unionByName(spark.createDataFrame([(None, 1.0)], "o double, s double"))


@query(f"""WITH {_GRID} SELECT o, s, CASE WHEN o IS NULL OR s IS NULL THEN 'n/a' WHEN abs(o - 1) < 0.1::DOUBLE THEN 'no DI to explain' WHEN abs(s - 1) < 0.4::DOUBLE * abs(o - 1) THEN 'marker-driven'
 WHEN abs(s - 1) > 0.7::DOUBLE * abs(o - 1) THEN 'content-driven' ELSE 'mixed' END AS label FROM g""")
def decomposition_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark).withColumn("label", decomposition_label(F.col("o"), F.col("s")))


@query(f"""WITH {_GRID} SELECT o, s, CASE WHEN o >= 0.8::DOUBLE THEN 'H1' WHEN o < 0.8::DOUBLE AND s <= 0.1::DOUBLE THEN 'H0' WHEN o >= 0.65::DOUBLE AND o < 0.8::DOUBLE AND s > 0.1::DOUBLE THEN 'ambiguous' ELSE 'undefined' END AS decision,
 CASE WHEN o < 0.7::DOUBLE THEN 'holds constant' WHEN o > 0.9::DOUBLE THEN 'meaningful variation' ELSE 'marginal' END AS verdict FROM g""")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark).withColumn("decision", prereg_decision(F.col("o"), F.col("s"))).withColumn("verdict", equivalence_verdict(F.col("o")))


@query("""WITH x AS (SELECT lang AS seed, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 0 ELSE 1 END AS grp, n_chars FROM documents)
SELECT seed, grp, count(*) AS n, round(avg(n_chars::DOUBLE), 4) AS mean_score FROM x GROUP BY ALL""")
def within_seed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("seed"), F.when(F.col("source").isin("src0", "src1", "src2"), 0).otherwise(1).alias("grp"), "n_chars")
    return rows.groupBy("seed", "grp").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("n_chars").cast("double")), 4).alias("mean_score"))


@query("""WITH p AS (SELECT o_orderpriority AS cell, count(*)::DOUBLE / sum(count(*)) OVER () / 4 AS p_value FROM orders GROUP BY 1),
r AS (SELECT cell, p_value, rank() OVER (ORDER BY p_value NULLS LAST) AS rank, count(p_value) OVER () AS n_tests FROM p),
b AS (SELECT *, max(CASE WHEN p_value <= 0.05::DOUBLE * rank / n_tests THEN rank END) OVER () AS last FROM r)
SELECT cell, round(p_value, 6) AS p_value, rank, n_tests, p_value <= 0.05::DOUBLE / n_tests AS bonferroni, coalesce(rank <= last, false) AS bh FROM b""")
def multiple_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    rows = counts.crossJoin(F.broadcast(total)).select("cell", (F.col("c").cast("double") / F.col("t") / 4).alias("p_value"))
    return r6(metrics.multiple_comparisons(rows)).select("cell", "p_value", "rank", "n_tests", "bonferroni", "bh")
