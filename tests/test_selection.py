"""Selection and metrics against small hand-made tables, and relations that must hold."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from paritas.functions import scalars
from paritas.operators import inference, metrics, models, selection
from paritas.operators import simulation as sim
from paritas.plans import audits


def frame(spark, rows, schema="id int, score double, grp int"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def ten(spark):
    scores = [9.0, 8.0, 7.0, 7.0, 7.0, float("nan"), None, 3.0, 2.0, 1.0]
    return frame(spark, [(i, s, i % 2) for i, s in enumerate(scores)])


def chosen(df, **kw):
    return {r["id"] for r in selection.top_k(df, "score", ["id"], kw.pop("fraction", 0.3), **kw).collect() if r["selected"]}


def test_best_rows_are_selected_and_ties_filled_up(ten):
    got = chosen(ten)
    assert {0, 1} < got and len(got) == 3 and got < {0, 1, 2, 3, 4}


def test_missing_scores_come_last_but_count(ten):
    assert len(chosen(ten, fraction=0.8)) == 8
    assert not {5, 6} & chosen(ten, fraction=0.8)
    assert len(chosen(ten, fraction=1.0)) == 10


@pytest.mark.parametrize("fraction,least,n", [(0.0, 1, 1), (0.0, 0, 0), (0.25, 1, 2), (0.35, 1, 4), (0.05, 0, 0)])
def test_k_rounds_half_to_even(ten, fraction, least, n):
    assert len(chosen(ten, fraction=fraction, min_k=least)) == n


def test_selection_does_not_depend_on_partitions(spark, ten):
    assert chosen(ten) == chosen(ten.repartition(7)) == chosen(ten.orderBy(F.col("id").desc()).coalesce(1))


def test_selection_survives_monotone_changes_of_scores(ten):
    assert chosen(ten) == chosen(ten.withColumn("score", F.exp(F.col("score")) * 3 + 1))


def test_counts_agree_with_a_full_ranking(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.monotonically_increasing_id().alias("id"), F.col("l_discount").alias("score"), "l_returnflag").cache()
    a = selection.top_k(lines, "score", ["id"], 0.3, ["l_returnflag"]).groupBy("l_returnflag").agg(F.sum("selected").alias("k"), F.sum(F.col("selected") * F.col("id")).alias("s"))
    ranks = selection.ranked(lines, "score", ["id"], ["l_returnflag"])
    b = ranks.where(F.col("rk") <= scalars.k_of(0.3, F.col("n"))).groupBy("l_returnflag").agg(F.count("id").alias("k"), F.sum("id").alias("s"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_empty_table(spark):
    none = frame(spark, [])
    assert selection.top_k(none, "score", ["id"], 0.3).count() == 0
    row = selection.disparate_impact(none, "score", "grp", ["id"], 0.3).first()
    assert row["n_group0"] == 0 and row["disparate_impact"] is None


def test_impact_is_null_without_selected_rows_of_group_1(spark):
    row = selection.disparate_impact(frame(spark, [(1, 9.0, 0), (2, 1.0, 1), (3, 5.0, -1)]), "score", "grp", ["id"], 0.34).first()
    assert row["selection_rate_group0"] == 1 and row["disparate_impact"] is None and row["n_group1"] == 1


def test_swapped_groups_give_the_inverse(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), (F.col("c_nationkey") % 2).alias("grp"))
    di = lambda df: selection.disparate_impact(df, "score", "grp", ["id"], 0.2).first()["disparate_impact"]
    assert di(rows) == pytest.approx(1 / di(rows.withColumn("grp", 1 - F.col("grp"))))


def test_group_0_wins_a_value_of_both(spark):
    got = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string").select(scalars.binary_group(F.col("v"), ["a"], ["a", "b"]).alias("g"))
    assert [r["g"] for r in got.collect()] == [0, 1, -1, -1]


def test_outcomes_by_hand(spark):
    rows = [(0, 1, 1, 0.9), (0, 1, 0, 0.4), (0, 0, 1, 0.6), (0, 0, 0, 0.1), (1, 0, 0, 0.2), (1, 0, 0, 0.3)]
    got = {r["grp"]: r for r in metrics.group_outcomes(spark.createDataFrame(rows, "group int, label int, yhat int, proba double")).collect()}
    assert (got[0]["tpr"], got[0]["fpr"], got[0]["precision"], got[0]["n"]) == (0.5, 0.5, 0.5, 4)
    assert got[1]["tpr"] is None and got[1]["precision"] is None and got[1]["tnr"] == 1
    assert got[0]["brier_score"] == pytest.approx((0.01 + 0.36 + 0.36 + 0.01) / 4)


def test_proxy_of_a_constant_feature(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 2.0), (1, 5.0, 2.0), (1, None, 2.0)], "group int, a double, b double")
    got = {r["feature"]: r for r in metrics.proxy_audit(rows, ["a", "b"]).collect()}
    assert got["b"]["pearson_corr_with_group"] is None and got["b"]["standardized_mean_difference"] is None
    assert got["a"]["mean_difference"] == pytest.approx(1.5 - 5)


def test_interval_drops_missing_and_interpolates(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, float("nan"), None)], "x double")
    got = metrics.percentile_interval(rows, "x").first()
    assert got["n_reps"] == 4 and got["point"] == 2.5 and got["ci_lo"] == pytest.approx(1.075) and got["ci_hi"] == pytest.approx(9.475)
    empty = metrics.percentile_interval(rows.where("x < 0"), "x").first()
    assert empty["mean"] is None and empty["n_reps"] == 0


def exact(n0, n1, k, x):
    """Mass of all splits as extreme as ``x``, by binomials."""
    di = lambda v: (v / n0) / ((k - v) / n1)
    mass = {v: math.comb(n0, v) * math.comb(n1, k - v) for v in range(max(0, k - n1), min(k, n0) + 1) if v < k}
    return sum(m for v, m in mass.items() if abs(di(v) - 1) >= abs(di(x) - 1) - 1e-12) / sum(mass.values())


@pytest.mark.parametrize("n0,n1,x,k", [(12, 8, 3, 6), (5, 15, 1, 4), (30, 10, 9, 12)])
def test_exact_permutation_against_binomials(spark, n0, n1, x, k):
    rows, at = [], 0
    for group, n, top in ((0, n0, x), (1, n1, k - x)):
        for i in range(n):
            rows.append((at, 1.0 if i < top else 0.0, group))
            at += 1
    got = inference.permutation_exact(frame(spark, rows), "score", "grp", ["id"], k / (n0 + n1)).first()
    assert got["k"] == k and got["p_value"] == pytest.approx(exact(n0, n1, k, x))


def test_monte_carlo_is_near_the_exact_value(spark):
    rows = [(i, float((i * 37) % 101), int(i % 3 == 0)) for i in range(60)]
    a = inference.permutation_exact(frame(spark, rows), "score", "grp", ["id"], 0.3).first()["p_value"]
    b = inference.permutation_mc(frame(spark, rows), "score", "grp", ["id"], 0.3, 400).first()
    assert b["n_perms_run"] == 400 and abs(a - b["p_value"]) < 4 * math.sqrt(a * (1 - a) / 400) + 1 / 401


def test_published_exact_value():
    # 384 documents, 256 and 128 in the groups, 115 selected, ratio 0.65: 65 and 50 selected
    assert exact(256, 128, 115, 65) == pytest.approx(0.05652, abs=1e-5)


def test_unknown_tail(spark, ten):
    with pytest.raises(ValueError):
        inference.permutation_exact(ten, "score", "grp", ["id"], 0.3, tails=["both"])


def test_paired_permutation_of_equal_scores(spark):
    rows = frame(spark, [(i, float(i), i % 2) for i in range(20)]).withColumn("after", F.col("score"))
    got = inference.paired_permutation(rows, "score", "after", "grp", ["id"], 0.3, 10).first()
    assert got["delta_observed"] == 0 and got["p_value"] == 1


def test_bootstrap_keeps_group_sizes(spark):
    rows = frame(spark, [(i, float(i), int(i < 5)) for i in range(25)])
    got = inference.bootstrap_reps(rows, "score", "grp", ["id"], 0.2, 8).collect()
    assert len(got) == 8 and all((5 * r["selection_rate_group1"] + 20 * r["selection_rate_group0"]) == pytest.approx(5) for r in got)


def resampled(rows, fraction, reps, stratified):
    """Rates of ``bootstrap_reps`` by ranking all draws, in plain Python; rows (id, score, grp, cell)."""
    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    out = {}
    for c in {r[3] for r in rows}:
        own = sorted((r for r in rows if r[3] == c and r[2] in (0, 1)), key=lambda r: md5(0, r[0]))
        for rep in range(reps):
            drawn = []
            for g in (0, 1) if stratified else (None,):
                part = [r for r in own if g in (None, r[2])]
                name = (c,) if g is None else (c, g)
                drawn += [(part[int(md5(0, rep, *name, j)[:7], 16) % len(part)], j) for j in range(len(part))]
            drawn.sort(key=lambda x: (x[0][1] is None, -(x[0][1] or 0.0), md5(0, rep, x[0][2], x[1])))
            k, n = max(1, round(fraction * len(drawn))), [sum(r[2] == g for r, _ in drawn) for g in (0, 1)]
            out[c, rep] = tuple(sum(r[2] == g for r, _ in drawn[:k]) / n[g] for g in (0, 1))
    return out


@pytest.mark.parametrize("stratified,deviations,share", [(True, 8, 0.2), (False, 8, 0.2), (False, -8, 0.2), (False, 8, 0.95)])
def test_bootstrap_equals_a_ranking_of_all_draws(spark, monkeypatch, stratified, deviations, share):
    # with -8 deviations, brackets miss the borders: repetitions are ranked whole
    monkeypatch.setattr(inference, "DRAW_DEVIATIONS", deviations)
    rows = [(i, None if i % 11 == 0 else float(i * 7919 % 1500) / 4, i % 4 - 1, "ab"[i % 9 == 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, score double, grp int, cell string")
    got = inference.bootstrap_reps(df, "score", "grp", ["id"], share, 3, stratified=stratified, cells=["cell"]).collect()
    assert {(r["cell"], r["rep"]): (r["selection_rate_group0"], r["selection_rate_group1"]) for r in got} == resampled(rows, share, 3, stratified)


def test_axis_audit_skips_what_is_missing(spark):
    rows = spark.createDataFrame([(i, float(i), "Female" if i % 2 else "Male") for i in range(10)], "id int, s double, gender string")
    got = audits.axis_audit(rows, ["s", "gone"], {"gender": "gender", "unknown": "gender"}, ["id"], 0.2, n_bootstrap=5, permutations=True).collect()
    assert [(r["score_col"], r["axis"], r["group_0_label"]) for r in got] == [("s", "gender", "Female")]
    assert got[0]["bootstrap_n_reps"] is not None and 0 < got[0]["permutation_p_value"] <= 1


def test_simulated_moments(spark):
    rows = sim.applicants(spark.range(4000), 1, 0.18, 0.78, 0.3).cache()
    got = rows.agg(F.avg("score_a"), F.stddev("score_a"), F.avg("publications"), F.variance("publications"), F.avg("group"), F.max("narrative_sentiment"), F.min("narrative_sentiment")).first()
    assert got[0] == pytest.approx(250, abs=0.8) and got[1] == pytest.approx(10, abs=0.5) and got[2] == pytest.approx(3, abs=0.15) and got[3] == pytest.approx(3, abs=0.4)
    assert got[4] == pytest.approx(0.5, abs=0.04) and got[5] <= 1 and got[6] >= -1
    means = {r["group"]: r["m"] for r in rows.groupBy("group").agg(F.avg("narrative_sentiment").alias("m")).collect()}
    assert means[0] == pytest.approx(0.18, abs=0.03) and means[1] == pytest.approx(0.74, abs=0.04)


def test_oracle_scorers_by_hand(spark):
    row = spark.createDataFrame([(260.0, 4, 3.6, -1.0, 0.5, 0.5)], ", ".join(f"{f} {'int' if f == 'publications' else 'double'}" for f in sim.FEATURES))
    c = [0.3, 0.08, 0.0, -0.12, 0.04, 0.6]
    got = row.select(sim.linear_score().alias("a"), sim.power_score(2).alias("b"), sim.power_score(3).alias("c")).first()
    sig = lambda z: 1 / (1 + math.exp(-z))
    assert got["a"] == pytest.approx(sig(sum(c))) and got["b"] == pytest.approx(sig(sum(math.copysign(x * x, x) for x in c))) and got["c"] == pytest.approx(sig(sum(x**3 for x in c)))


def test_published_baseline_lies_in_our_interval(spark):
    """Instrument b, true weights, 12 % invited: published median ratio 0.302."""
    ids = spark.range(3000).crossJoin(spark.range(12).withColumnRenamed("id", "rep"))
    rows = sim.applicants(ids, 5, 0.02, 0.23, 0.1, F.col("rep")).withColumn("proba", sim.linear_score())
    per = selection.group_rates(selection.rank_select(rows, "proba", "id", 0.12, ["rep"]), "group", "yhat", ["rep"])
    got = metrics.percentile_interval(per, "disparate_impact").first()
    assert got["ci_lo"] < 0.302 < got["ci_hi"]


def test_logistic_fit_and_calibration(spark):
    rows = sim.applicants(spark.range(3000), 9, 0.18, 0.78, 0.3).cache()
    fitted = models.fit(rows, "logistic_regression")
    weights = {r["feature"]: r["standardized_coefficient"] for r in models.coefficients(fitted, spark).collect()}
    assert weights["narrative_sentiment"] > 0.2 and weights["score_a"] > 0.1
    cal = {r["part"]: r for r in models.calibration(models.score(fitted, rows)).collect()}
    assert cal["group_0"]["calibration_slope"] == pytest.approx(1, abs=0.5)
    few = models.calibration(rows.limit(5).withColumn("proba", F.lit(0.5))).collect()
    assert all(r["calibration_slope"] is None for r in few)


def test_comparisons(spark):
    got = {r["p"]: (r["bonferroni"], r["bh"]) for r in metrics.multiple_comparisons(spark.createDataFrame([(0.001,), (0.02,), (0.03,), (0.9,), (None,)], "p double"), "p").collect()}
    assert got[0.001] == (True, True) and got[0.02] == (False, True) and got[0.03] == (False, True) and got[0.9] == (False, False) and got[None][1] is False
