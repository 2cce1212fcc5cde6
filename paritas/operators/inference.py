"""Permutation tests and bootstraps of the disparate impact of a top-K selection.

Labels of a fixed selection: the number of selected rows of group 0 is hypergeometric, so the permutation test is a
finite sum over that number (``permutation_exact``); the Monte-Carlo form is kept beside it. Draws are hashes of
(seed, repetition, place), so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.scalars import finite, hash_int, k_of, ratio, tie_key
from paritas.operators.metrics import percentile_interval
from paritas.operators.selection import ranked, top_k, with_impact

#: Two ratios closer than this are equal in comparisons.
TOLERANCE = 1e-12
TAILS = ("two-sided", "lower", "upper")


def extreme(di: Column, observed: Column, tail: str) -> Column:
    if tail == "two-sided":
        return F.abs(di - 1) >= F.abs(observed - 1) - TOLERANCE
    if tail == "lower":
        return di <= observed + TOLERANCE
    if tail == "upper":
        return di >= observed - TOLERANCE
    raise ValueError(f"tail must be one of {TAILS}: {tail}")


def _selected_counts(df: DataFrame, score: str, group: str, keys: Sequence[str], fraction: float, cells: Sequence[str], seed: int) -> DataFrame:
    """Per cell: n0, n1, K and x, the selected rows of group 0; other groups go before the selection."""
    rows = top_k(df.where(F.col(group).isin(0, 1)), score, keys, fraction, cells, seed)
    g0 = F.col(group) == 0
    return rows.groupBy(*cells).agg(F.count(F.when(g0, 1)).alias("n0"), F.count(F.when(~g0, 1)).alias("n1"), F.sum("selected").cast("long").alias("k"), F.count(F.when(g0 & (F.col("selected") == 1), 1)).alias("x"))


#: Deviations around the mode of the hypergeometric mass that are summed; beyond, it is less than a double can hold.
DEVIATIONS = 40


def ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from 10 on, by sums of logarithms below."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(10)))
    return F.when(n < 10, F.get(small, n.cast("int"))).otherwise(series)


def permutation_exact(df: DataFrame, score: str, group: str, keys: Sequence[str], fraction: float, cells: Sequence[str] = (), seed: int = 0, tails: Sequence[str] = ("two-sided",)) -> DataFrame:
    """Exact p-value per cell (and tail): the hypergeometric mass of all splits as extreme as the observed one.

    Splits that leave group 1 without a selected row have no ratio and are left out, of numerator and denominator. Each
    mass is computed by itself, over the deviations around the mode that a double can hold: rows grow with the root of K.
    """
    counts = _selected_counts(df, score, group, keys, fraction, cells, seed)
    n0, n1, k = (F.col(c).cast("double") for c in ("n0", "n1", "k"))
    n = n0 + n1
    mode = F.floor((n0 + 1) * (k + 1) / (n + 2))
    reach = F.ceil(DEVIATIONS * F.sqrt(k * n0 / n * n1 / n * (n - k) / F.greatest(n - 1, F.lit(1.0)))) + 50
    low, high = F.greatest(F.lit(0), F.col("k") - F.col("n1"), (mode - reach).cast("long")), F.least(F.col("k"), F.col("n0"), (mode + reach).cast("long"))
    mass = lambda v: -(ln_factorial(v) + ln_factorial(F.col("n0") - v) + ln_factorial(F.col("k") - v) + ln_factorial(F.col("n1") - F.col("k") + v))
    rows = counts.withColumn("di", ratio(F.col("x") * F.col("n1"), F.col("n0") * (F.col("k") - F.col("x"))))
    rows = rows.withColumn("top", F.least(F.greatest(mode.cast("long"), F.lit(0), F.col("k") - F.col("n1")), F.col("k"), F.col("n0"))).withColumn("v", F.explode(F.sequence(low, high)))
    rows = rows.withColumn("w", F.exp(mass(F.col("v")) - mass(F.col("top"))))
    cell = [*cells, "n0", "n1", "k", "x", "di"]
    rows = rows.withColumn("dv", ratio(F.col("v") * F.col("n1"), F.col("n0") * (F.col("k") - F.col("v"))))
    out = None
    for tail in tails:
        part = rows.groupBy(*cell).agg(ratio(F.sum(F.when(extreme(F.col("dv"), F.col("di"), tail), F.col("w"))), F.sum(F.when(F.col("dv").isNotNull(), F.col("w")))).alias("p_value"))
        part = part.select(*cells, F.lit(tail).alias("tail"), "n0", "n1", "k", F.col("di").alias("observed_di"), "p_value")
        out = part if out is None else out.unionByName(part)
    return out


def permutation_mc(df: DataFrame, score: str, group: str, keys: Sequence[str], fraction: float, reps: int, seed: int = 0, tail: str = "two-sided") -> DataFrame:
    """Monte-Carlo form: per repetition the group labels are dealt anew by hash order; p = (extreme + 1) / (valid + 1)."""
    rows = top_k(df.where(F.col(group).isin(0, 1)), score, keys, fraction, (), seed).select(*keys, F.col(group).alias("g_"), "selected")
    n0 = rows.agg(F.count(F.when(F.col("g_") == 0, 1)).alias("n0"), F.count(F.when(F.col("g_") == 1, 1)).alias("n1"), F.avg(F.when(F.col("g_") == 0, F.col("selected").cast("double"))).alias("r0"), F.avg(F.when(F.col("g_") == 1, F.col("selected").cast("double"))).alias("r1"))
    n0 = n0.withColumn("observed_di", ratio(F.col("r0"), F.col("r1")))
    dealt = rows.crossJoin(df.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    order = Window.partitionBy("rep").orderBy(tie_key(F.lit(seed), F.col("rep"), *map(F.col, keys)))
    dealt = dealt.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(n0))
    in0 = F.col("place") <= F.col("n0")
    per = dealt.groupBy("rep", "observed_di").agg(F.avg(F.when(in0, F.col("selected").cast("double"))).alias("a"), F.avg(F.when(~in0, F.col("selected").cast("double"))).alias("b")).withColumn("di", ratio(F.col("a"), F.col("b")))
    got = per.groupBy("observed_di").agg(F.count(F.lit(1)).alias("n_perms_run"), F.count("di").alias("n_perms_valid"), F.count(F.when(extreme(F.col("di"), F.col("observed_di"), tail), 1)).alias("n_extreme"))
    return got.select("observed_di", ((F.col("n_extreme") + 1) / (F.col("n_perms_valid") + 1)).alias("p_value"), "n_perms_run", "n_perms_valid", "n_extreme", F.lit(tail).alias("tail"))


#: Buckets by the first hexadecimal digits of a hash, in which rows are numbered, and positions that one array of states holds.
DIGITS, CHUNK = 3, 1 << 16
#: Half widths of brackets around the border, in ranks over n; the accuracy of the sketch; deviations of the number of draws above a score.
HALVES, SKETCH, DRAW_DEVIATIONS = tuple(2.0**-i for i in range(1, 11)), 10_000, 8


def _numbered(rows: DataFrame, stratum: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """``rows`` with their number in the stratum, by tie hash (``at``), and its size (``m``): places in buckets of the hash, and sizes of the buckets before."""
    hashed = rows.withColumn("h_", tie_key(seed, *map(F.col, keys))).withColumn("p_", F.substring("h_", 1, DIGITS))
    sizes = hashed.groupBy(*stratum, "p_").agg(F.count(F.lit(1)).alias("c_"))
    whole = Window.partitionBy(*stratum)
    before = F.sum("c_").over(whole.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before_", F.coalesce(before, F.lit(0))).withColumn("m", F.sum("c_").over(whole)).drop("c_")
    place = F.row_number().over(Window.partitionBy(*stratum, "p_").orderBy("h_")) - 1
    return hashed.join(sizes, [*stratum, "p_"]).withColumn("at", (F.col("before_") + place).cast("long")).drop("h_", "p_", "before_")


def _draw_bracket(rows: DataFrame, fraction: float, cells: Sequence[str]) -> DataFrame:
    """Per cell: scores (missing: least) between which the border of a resample lies, by deviations of a binomial number; null for a few rows."""
    p = [x for h in HALVES for x in (max(0.0, 1 - fraction - h), min(1.0, 1 - fraction + h))]
    stats = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("z_", p, SKETCH).alias("q_"))
    need = (DRAW_DEVIATIONS * F.sqrt(fraction * (1 - fraction) * F.col("n_")) + DRAW_DEVIATIONS**2) / F.col("n_") + 2 / SKETCH
    end = lambda side: F.coalesce(*(F.when(need <= h, F.get("q_", F.lit(2 * i + side))) for i, h in reversed(list(enumerate(HALVES)))))
    return stats.select(*cells, end(0).alias("lo_"), end(1).alias("hi_"))


def _resampled(numbered: DataFrame, reps: DataFrame, fraction: float, seed: int, stratum: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Per cell and repetition: selection rates of the groups, and whether the border lies among the draws that were ranked (``holds_``).

    ``numbered`` has ``state_``: 2 for rows above any border, 1 for rows near it, 0 for rows below. ``reps``: rows (cells,
    rep), or rep alone for all cells. States and groups are looked up by position in arrays, a byte a row, that are
    broadcast; draws are counted by group and state, only those near the border are ranked.
    """
    code = F.struct("at", (F.col("g_") * 3 + F.col("state_")).cast("tinyint").alias("c"))
    chunks = numbered.groupBy(*stratum, F.shiftright("at", 16).alias("part_")).agg(F.max("m").alias("m"), F.sort_array(F.collect_list(code)).getField("c").alias("codes_"))
    units = chunks.select(*stratum, "m", F.col("part_").alias("of_"))
    some = [c for c in cells if c in reps.columns]
    dealt = reps.join(F.broadcast(units), some) if some else reps.crossJoin(F.broadcast(units))
    first = F.col("of_") * CHUNK
    draws = dealt.withColumn("j", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("m")) - 1)))
    name = [F.col(c) for c in stratum] or [F.lit("all")]
    # never null, or the join would test it by a second hash
    at = F.coalesce(F.pmod(hash_int(F.lit(seed), F.col("rep"), *name, F.col("j")), F.col("m")), F.lit(0).cast("long"))
    draws = draws.select(*stratum, "rep", "j", at.alias("at"))
    draws = draws.withColumn("part_", F.shiftright("at", 16)).join(F.broadcast(chunks.drop("m")), [*stratum, "part_"])
    draws = draws.withColumn("c_", F.get("codes_", F.col("at").bitwiseAND(CHUNK - 1)).cast("int"))
    near = F.col("c_") % 3 == 1
    seen = draws.select(*cells, "rep", F.floor(F.col("c_") / 3).cast("int").alias("g_"), (F.col("c_") % 3).alias("state_"), F.when(near, F.col("at")).alias("at"), F.when(near, F.col("j")).alias("j"))
    seen = seen.groupBy(*cells, "rep", "g_", "state_", "at", "j").agg(F.count(F.lit(1)).alias("c_"))
    seen = seen.join(numbered.where("state_ = 1").select(*stratum, "at", "s_"), [*stratum, "at"], "left")
    place = F.row_number().over(Window.partitionBy(*cells, "rep", "state_").orderBy(F.col("s_").desc_nulls_last(), tie_key(F.lit(seed), F.col("rep"), F.col("g_"), F.col("j"))))
    cell = Window.partitionBy(*cells, "rep")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c_"))), F.lit(0))
    state = F.col("state_")
    sel = seen.withColumn("rk_", place).withColumn("over_", F.sum(F.when(state == 2, F.col("c_")).otherwise(0)).over(cell)).withColumn("k_", k_of(fraction, F.sum("c_").over(cell)))
    sel = sel.withColumn("sel_", (state == 2) | (state == 1) & (F.col("over_") + F.col("rk_") <= F.col("k_")))
    rate = lambda g: ratio(count((F.col("g_") == g) & F.col("sel_")), count(F.col("g_") == g)).alias(f"selection_rate_group{g}")
    return sel.groupBy(*cells, "rep").agg(rate(0), rate(1), (F.max("over_") <= F.max("k_")).alias("low_"), (F.max("over_") + count(state == 1) >= F.max("k_")).alias("high_")).withColumn("holds_", F.col("low_") & F.col("high_")).drop("low_", "high_")


def bootstrap_reps(df: DataFrame, score: str, group: str, keys: Sequence[str], fraction: float, reps: int, seed: int = 0, stratified: bool = True, cells: Sequence[str] = ()) -> DataFrame:
    """Per cell and repetition: ratio of the selection rates in a resample of the original size (of each group).

    Draw j of a repetition takes row number hash(seed, rep, stratum, j) mod n of its stratum. Rows of other groups go.
    The border of a resample lies near the table's, so only draws in a bracket around it are ranked; a repetition whose
    bracket does not hold its border is ranked whole.
    """
    rows = df.where(F.col(group).isin(0, 1)).select(*cells, *keys, F.col(group).cast("int").alias("g_"), finite(F.col(score)).alias("s_"))
    stratum = [*cells, "g_"] if stratified else [*cells]
    rows = rows.withColumn("z_", F.coalesce("s_", F.lit(float("-inf"))))
    bracket = _draw_bracket(rows, fraction, cells)
    rows = _numbered(rows, stratum, keys, seed).select(*dict.fromkeys([*stratum, "g_"]), "at", "m", "s_", "z_")
    met = rows.join(F.broadcast(bracket), list(cells)) if cells else rows.crossJoin(F.broadcast(bracket))
    z = F.col("z_")
    state = F.when(F.col("lo_").isNull() | z.between(F.col("lo_"), F.col("hi_")), 1).when(z > F.col("hi_"), 2).otherwise(0)
    tasks = max(1, min(reps, 200))
    every = df.sparkSession.range(0, reps, 1, tasks).withColumnRenamed("id", "rep")
    out = _resampled(met.withColumn("state_", state).drop("z_", "lo_", "hi_"), every, fraction, seed, stratum, cells)
    # lists, which no filter passes: both uses read one exchange, and the draws are made once
    made = out.groupBy(*cells).agg(F.collect_list(F.struct("rep", "selection_rate_group0", "selection_rate_group1", "holds_")).alias("x")).select(*cells, F.explode("x").alias("x")).select(*cells, "x.*")
    missed = made.where("NOT holds_").select(*cells, "rep").repartition(tasks, "rep")
    again = _resampled(rows.withColumn("state_", F.lit(1)).drop("z_"), missed, fraction, seed, stratum, cells)
    return with_impact(made.where("holds_").unionByName(again).drop("holds_"))


def bootstrap_di(df: DataFrame, score: str, group: str, keys: Sequence[str], fraction: float, reps: int = 200, seed: int = 0, alpha: float = 0.05, stratified: bool = True, cells: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the bootstrapped ratio; repetitions without a ratio are dropped."""
    return percentile_interval(bootstrap_reps(df, score, group, keys, fraction, reps, seed, stratified, cells), "disparate_impact", cells, alpha)


def paired_permutation(df: DataFrame, before: str, after: str, group: str, keys: Sequence[str], fraction: float, reps: int, seed: int = 0, cells: Sequence[str] = ()) -> DataFrame:
    """Per cell, whether a change of scores changes the ratio: each row's two scores are swapped by coin flips, both selections made anew.

    A row's coin is the same in all cells.
    """
    rows = df.where(F.col(group).isin(0, 1)).select(*cells, *keys, F.col(group).alias("g_"), finite(F.col(before)).alias("a_"), finite(F.col(after)).alias("b_"))
    # repetition -1 is the observed pair
    all_reps = df.sparkSession.range(-1, reps).withColumnRenamed("id", "rep")
    flip = (F.col("rep") >= 0) & (hash_int(F.lit(seed), F.lit("flip"), F.col("rep"), *map(F.col, keys)) % 2 == 1)
    dealt = rows.crossJoin(F.broadcast(all_reps)).withColumn("flip", flip)
    both = dealt.select(*cells, "rep", *keys, "g_", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.when(F.col("flip"), F.col("b_")).otherwise(F.col("a_")).alias("s")),
        F.struct(F.lit(1).alias("side"), F.when(F.col("flip"), F.col("a_")).otherwise(F.col("b_")).alias("s")),
    )).alias("x")).select(*cells, "rep", *keys, "g_", "x.side", "x.s")
    sel = ranked(both, "s", keys, (*cells, "rep", "side"), seed).withColumn("sel", (F.col("rk") <= k_of(fraction, F.col("n"))).cast("double"))
    per = sel.groupBy(*cells, "rep", "side").agg(ratio(F.avg(F.when(F.col("g_") == 0, F.col("sel"))), F.avg(F.when(F.col("g_") == 1, F.col("sel")))).alias("di"))
    pair = per.groupBy(*cells, "rep").agg(F.max(F.when(F.col("side") == 0, F.col("di"))).alias("d0"), F.max(F.when(F.col("side") == 1, F.col("di"))).alias("d1")).withColumn("delta", F.col("d1") - F.col("d0"))
    # a row for each cell and repetition: the observed pair comes along in the aggregate
    observed = lambda c: F.max(F.when(F.col("rep") == -1, F.col(c)))
    deltas = F.filter(F.collect_list(F.when(F.col("rep") >= 0, F.struct(F.col("delta").alias("d")))), lambda x: x["d"].isNotNull())
    got = pair.groupBy(*cells).agg(
        observed("d0").alias("baseline_di"), observed("d1").alias("mitigated_di"), observed("delta").alias("delta_observed"),
        F.count(F.when(F.col("rep") >= 0, 1)).alias("n_perms_run"), deltas.alias("deltas_"),
    )
    far = F.filter("deltas_", lambda x: F.abs(x["d"]) >= F.abs(F.col("delta_observed")) - TOLERANCE)
    got = got.select(*cells, "baseline_di", "mitigated_di", "delta_observed", "n_perms_run", F.size("deltas_").cast("long").alias("n_perms_valid"), F.size(far).cast("long").alias("n_extreme"))
    return got.withColumn("p_value", (F.col("n_extreme") + 1) / (F.col("n_perms_valid") + 1))
