"""Top-K selection that does not depend on row order, and selection rates of groups.

``top_k`` never ranks all rows of a cell in one task: a sketch brackets the border, rows in the bracket are counted by
score (summed before the shuffle), the score at the border is found on these distinct scores, and the rows tied at it
are chosen by a hash of their keys. That hash is uniform, so its border is bracketed too: only ties whose hash lies in
a few deviations around it are ranked. A sweep over many K has a border for each, found together. ``ranked`` gives full
ranks, for resampled cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.scalars import finite, k_of, ratio, tie_key

#: Protected axes and the values of their two groups.
DEFAULT_AXES = {
    "gender": {"group_0_label": "Female", "group_1_label": "Male", "group_0_values": ["Female"], "group_1_values": ["Male"]},
    "race": {"group_0_label": "non-White", "group_1_label": "White", "group_0_values": ["Black", "Hispanic/Latino", "Asian"], "group_1_values": ["White"]},
    "school_tier": {"group_0_label": "lower-resource", "group_1_label": "top-tier", "group_0_values": ["lower_tier", "mid_tier"], "group_1_values": ["top_20"]},
}


def ranked(df: DataFrame, score: str, keys: Sequence[str], cells: Sequence[str] = (), seed: int = 0, to: str = "rk", size: str = "n") -> DataFrame:
    """``df`` with the rank of each row in its cell (best first, missing scores last, ties by hash) and the cell's size."""
    cell = Window.partitionBy(*cells)
    order = cell.orderBy(finite(F.col(score)).desc_nulls_last(), tie_key(seed, *map(F.col, keys)))
    return df.withColumn(to, F.row_number().over(order).cast("long")).withColumn(size, F.count(F.lit(1)).over(cell))


#: Half width, in ranks over n, of the bracket around the border in ``top_k``, and the accuracy of the sketch that finds it.
BRACKET, ACCURACY = 0.01, 1000


def _per_cell(rows: DataFrame, table: DataFrame, cells: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, one row per cell; without cells, one row."""
    return rows.join(table, list(cells)) if cells else rows.crossJoin(F.broadcast(table))


def _bracketed(s: DataFrame, fraction: float, cells: Sequence[str], min_k: int) -> DataFrame:
    """Per cell: K, and the scores that a mergeable sketch puts two hundredths of the ranks apart around it."""
    p = [max(0.0, 1 - fraction - BRACKET), min(1.0, 1 - fraction + BRACKET)]
    stats = s.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("s_", p, ACCURACY).alias("q_"))
    return stats.select(*cells, k_of(fraction, F.col("n_"), min_k).alias("k_"), F.get("q_", F.lit(0)).alias("lo_"), F.get("q_", F.lit(1)).alias("hi_"))


def _border(s: DataFrame, stats: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Per cell: the score at the border (``b_``), how many of its rows are wanted (``want_``) and there (``m_``); no row where K is 0.

    ``s`` has the column ``s_``, and the cells unless ``stats`` brings them (a small table that all rows meet). Only
    distinct scores inside the bracket are put in order. Where it does not hold the border (few rows, or a border among
    missing scores), it is widened to all scores of the cell.
    """
    meet = (lambda t: _per_cell(s, t, cells)) if set(cells) <= set(s.columns) else (lambda t: s.crossJoin(F.broadcast(t)))
    seen = meet(stats).groupBy(*cells, "k_", "lo_", "hi_").agg(F.count(F.when(F.col("s_") > F.col("hi_"), 1)).alias("over_"), F.count(F.when(F.col("s_").between(F.col("lo_"), F.col("hi_")), 1)).alias("in_"))
    holds = (F.col("over_") < F.col("k_")) & (F.col("over_") + F.col("in_") >= F.col("k_"))
    bracket = seen.where("k_ > 0").select(*cells, "k_", F.when(holds, F.col("lo_")).alias("lo_"), F.when(holds, F.col("hi_")).alias("hi_"), F.when(holds, F.col("over_")).otherwise(0).alias("over_"))
    inside = meet(bracket).where(F.col("lo_").isNull() | F.col("s_").between(F.col("lo_"), F.col("hi_")))
    counts = inside.groupBy(*cells, "k_", "over_", "s_").agg(F.count(F.lit(1)).alias("m_"))
    run = Window.partitionBy(*cells, "k_").orderBy(F.col("s_").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumn("upto_", F.col("over_") + F.sum("m_").over(run)).withColumn("above_", F.col("upto_") - F.col("m_"))
    return steps.where((F.col("above_") < F.col("k_")) & (F.col("upto_") >= F.col("k_"))).select(*cells, F.col("s_").alias("b_"), (F.col("k_") - F.col("above_")).alias("want_"), "m_", F.lit(True).alias("has_"))


def _sided(joined: DataFrame) -> DataFrame:
    """Rows with their border: ``state_`` is 2 above it, 1 at it, 0 below."""
    tied = F.col("s_").eqNullSafe(F.col("b_"))
    better = F.when(F.col("b_").isNull(), F.col("s_").isNotNull()).otherwise(F.coalesce(F.col("s_") > F.col("b_"), F.lit(False)))
    return joined.withColumn("state_", F.when(F.col("has_").isNull(), 0).when(tied, 1).when(better, 2).otherwise(0))


#: Deviations of the hash border to either side that are ranked.
DEVIATIONS = 8


def _ties(ties: DataFrame, cells: Sequence[str], keys: Sequence[str], seed: int, to: str) -> DataFrame:
    """Of the rows at the border (with ``want_`` and ``m_``), 1 for the ``want_`` of least hash of their keys.

    The first 52 bits of a hash are a uniform number, so the border lies near want/m; hashes below a bracket around it
    are in, those above are out. A cell whose bracket does not hold its border (by chance less than 1e-14) is ranked whole.
    """
    share = F.col("want_") / F.col("m_")
    half = DEVIATIONS * F.sqrt(share * (1 - share) / F.col("m_")) + 20 / F.col("m_")
    key = tie_key(seed, *map(F.col, keys))
    rows = ties.withColumn("h_", key).withColumn("u_", F.conv(F.substring("h_", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)))
    rows = rows.withColumn("side_", F.when(F.col("want_") == F.col("m_"), 0).when(F.col("u_") < share - half, 0).when(F.col("u_") <= share + half, 1).otherwise(2))
    per = rows.groupBy(*cells, "want_", "m_").agg(F.count(F.when(F.col("side_") == 0, 1)).alias("under_"), F.count(F.when(F.col("side_") == 1, 1)).alias("near_"))
    holds = (F.col("under_") <= F.col("want_")) & (F.col("under_") + F.col("near_") >= F.col("want_"))
    per = per.select(*cells, F.when(holds, F.col("want_") - F.col("under_")).alias("left_"))
    rows = _per_cell(rows, per, cells).withColumn("side_", F.when(F.col("left_").isNull(), 1).otherwise(F.col("side_")))
    place = F.row_number().over(Window.partitionBy(*cells).orderBy("h_"))
    near = rows.where("side_ = 1").withColumn(to, (place <= F.coalesce("left_", "want_")).cast("int"))
    return near.unionByName(rows.where("side_ <> 1").withColumn(to, (F.col("side_") == 0).cast("int")))


def top_k(df: DataFrame, score: str, keys: Sequence[str], fraction: float, cells: Sequence[str] = (), seed: int = 0, min_k: int = 1, to: str = "selected") -> DataFrame:
    """``df`` with 1 in ``to`` for the best rint(fraction * n) rows of each cell, 0 else.

    Missing scores count in n and come last. ``min_k`` is the least number selected.
    """
    s = df.withColumn("s_", finite(F.col(score)))
    plain = s.select(*cells, "s_")
    border = _border(plain, _bracketed(plain, fraction, cells, min_k), cells)
    out = _sided(s.join(border, list(cells), "left") if cells else s.join(F.broadcast(border), F.lit(True), "left"))
    ties = _ties(out.where("state_ = 1"), cells, keys, seed, to)
    rest = out.where("state_ <> 1").withColumn(to, (F.col("state_") == 2).cast("int"))
    return ties.select(*df.columns, to).unionByName(rest.select(*df.columns, to))


def group_rates(df: DataFrame, group: str, selected: str, cells: Sequence[str] = ()) -> DataFrame:
    """One row per cell: sizes and selection rates of groups 0 and 1, their ratio and difference; other groups are left out."""
    g0, g1 = F.col(group) == 0, F.col(group) == 1
    out = df.groupBy(*cells).agg(
        F.count(F.when(g0, 1)).alias("n_group0"), F.count(F.when(g1, 1)).alias("n_group1"),
        F.avg(F.when(g0, F.col(selected).cast("double"))).alias("selection_rate_group0"),
        F.avg(F.when(g1, F.col(selected).cast("double"))).alias("selection_rate_group1"),
    )
    return with_impact(out)


def with_impact(rates: DataFrame) -> DataFrame:
    a, b = F.col("selection_rate_group0"), F.col("selection_rate_group1")
    return rates.withColumn("disparate_impact", ratio(a, b)).withColumn("statistical_parity_difference", a - b)


def disparate_impact(df: DataFrame, score: str, group: str, keys: Sequence[str], fraction: float, cells: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Select over all rows, then compare the two groups."""
    return group_rates(top_k(df, score, keys, fraction, cells, seed), group, "selected", cells)


def threshold_sweep(df: DataFrame, proba: str, group: str, keys: Sequence[str], rates: Sequence[float], seed: int = 0) -> DataFrame:
    """For each rate: threshold, rates of the groups, ratio and difference. K may be 0: nothing is selected and the threshold is infinite.

    One sketch brackets the borders of all rates; rows are summed by rate before any shuffle, and no ranking is made but
    of the ties near a border.
    """
    s = df.select(*dict.fromkeys([group, *keys]), finite(F.col(proba)).alias("s_"))
    # dict keys of two decimals: rates that agree there are one
    some = [float(r) for r in dict((f"{r:.2f}", r) for r in rates).values()]
    p = [x for r in some for x in (max(0.0, 1 - r - BRACKET), min(1.0, 1 - r + BRACKET))]
    stats = s.agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("s_", p, ACCURACY).alias("q_"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.get("q_", F.lit(2 * i)).alias("lo_"), F.get("q_", F.lit(2 * i + 1)).alias("hi_")) for i, r in enumerate(some)))).alias("x")
    stats = stats.select("n_", each).select("x.rate", k_of(F.col("x.rate"), F.col("n_"), 0).alias("k_"), "x.lo_", "x.hi_")
    border = _border(s.select("s_"), stats, ["rate"])
    every = stats.select("rate").join(border, "rate", "left")  # a row per rate
    out = _sided(s.crossJoin(F.broadcast(every)))
    ties = _ties(out.where("state_ = 1"), ["rate"], keys, seed, "sel")
    both = out.where("state_ <> 1").select("rate", group, "s_", (F.col("state_") == 2).cast("int").alias("sel")).unionByName(ties.select("rate", group, "s_", "sel"))
    g0, g1 = F.col(group) == 0, F.col(group) == 1
    got = both.groupBy("rate").agg(
        F.coalesce(F.min(F.when(F.col("sel") == 1, F.col("s_"))), F.lit(float("inf"))).alias("threshold"),
        F.avg(F.when(g0, F.col("sel").cast("double"))).alias("selection_rate_group0"), F.avg(F.when(g1, F.col("sel").cast("double"))).alias("selection_rate_group1"),
    )
    return with_impact(got)


def rank_select(df: DataFrame, proba: str, key: str, rate: float, cells: Sequence[str] = ()) -> DataFrame:
    """The first rint(rate * n) rows by score, ties by key; K may be 0. Only the rows tied at the border are ranked."""
    s = df.withColumn("s_", finite(F.col(proba)))
    plain = s.select(*cells, "s_")
    border = _border(plain, _bracketed(plain, rate, cells, 0), cells)
    out = _sided(s.join(border, list(cells), "left") if cells else s.join(F.broadcast(border), F.lit(True), "left"))
    place = F.row_number().over(Window.partitionBy(*cells).orderBy(key))
    ties = out.where("state_ = 1").withColumn("yhat", (place <= F.col("want_")).cast("int"))
    rest = out.where("state_ <> 1").withColumn("yhat", (F.col("state_") == 2).cast("int"))
    return ties.select(*df.columns, "yhat").unionByName(rest.select(*df.columns, "yhat"))


def rank_replicates(df: DataFrame, proba: str, key: str, rate: float, cells: Sequence[str]) -> DataFrame:
    """``rank_select`` by one ranking a cell: for replicates of a simulation, many cells whose size is a parameter."""
    cell = Window.partitionBy(*cells)
    rows = df.withColumn("rk_", F.row_number().over(cell.orderBy(finite(F.col(proba)).desc_nulls_last(), F.col(key)))).withColumn("n_", F.count(F.lit(1)).over(cell))
    return rows.withColumn("yhat", (F.col("rk_") <= k_of(rate, F.col("n_"), 0)).cast("int")).drop("rk_", "n_")
