"""Permutation tests, bootstraps and the composite axis audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.scalars import rounded
from paritas.operators import inference, selection
from paritas.plans import audits
from paritas.queries.roles import APPLICANTS, RATES, applicants, sel, table
from paritas.queries.selection import r6

QUERIES: dict = {}
SQL: dict = {}

#: Repetitions of the resampling queries, of one cell and of several; each has a row per repetition and applicant.
REPS, CELL_REPS = 200, 20


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _exact_sql(source: str, cells: str = "", fraction: float = 0.2) -> str:
    """SQL of the exact permutation test, with lgamma; ``cells``: comma-ended column list."""
    part = cells.rstrip(", ")
    by = f"GROUP BY {part}" if part else ""
    return f"""f AS (SELECT * FROM {source} WHERE grp IN (0, 1)), {sel('f', fraction, cells=part)},
q AS (SELECT {cells} count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, sum(selected)::BIGINT AS k, count(*) FILTER (grp = 0 AND selected = 1) AS x FROM s {by}),
v AS (SELECT *, x::DOUBLE * n1 / nullif(n0::DOUBLE * (k - x), 0) AS di, unnest(range(greatest(0, k - n1), least(k, n0) + 1)) AS v FROM q),
w AS (SELECT *, -lgamma(v + 1.0) - lgamma(n0 - v + 1.0) - lgamma(k - v + 1.0) - lgamma(n1 - k + v + 1.0) AS lw, v::DOUBLE * n1 / nullif(n0::DOUBLE * (k - v), 0) AS dv FROM v),
m AS (SELECT *, exp(lw - max(lw) OVER ({f'PARTITION BY {part}' if part else ''})) AS wt FROM w)"""


_TAIL = {"two-sided": "abs(dv - 1) >= abs(di - 1) - 1e-12", "lower": "dv <= di + 1e-12", "upper": "dv >= di - 1e-12"}


def _tails(names: tuple, cells: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {cells} '{t}' AS tail, n0, n1, k, round(di, 6) AS observed_di, round(sum(CASE WHEN {_TAIL[t]} THEN wt END) / sum(CASE WHEN dv IS NOT NULL THEN wt END), 6) AS p_value FROM m GROUP BY {cells} n0, n1, k, di" for t in names
    )


@query(f"WITH {APPLICANTS}, {_exact_sql('a')} {_tails(('two-sided',))}")
def permutation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(inference.permutation_exact(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2))


@query(f"WITH {APPLICANTS}, {_exact_sql('a')} {_tails(inference.TAILS)}")
def permutation_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(inference.permutation_exact(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2, tails=inference.TAILS))


@query(f"WITH {APPLICANTS}, {_exact_sql('a', 'nation, ')} {_tails(('two-sided',), 'nation, ')}")
def permutation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(inference.permutation_exact(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2, ["nation"]))


@query(f"""WITH {APPLICANTS}, f AS (SELECT * FROM a WHERE grp IN (0, 1)), {sel('f', 0.2)},
o AS (SELECT count(*) FILTER (grp = 0) AS n0, avg(selected::DOUBLE) FILTER (grp = 0) / nullif(avg(selected::DOUBLE) FILTER (grp = 1), 0) AS di FROM s),
d AS (SELECT rep, selected, row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || id)) AS place FROM s, (SELECT unnest(range(0, {REPS})) AS rep)),
p AS (SELECT rep, avg(selected::DOUBLE) FILTER (place <= n0) / nullif(avg(selected::DOUBLE) FILTER (place > n0), 0) AS dv FROM d, o GROUP BY rep)
SELECT round(di, 6) AS observed_di, round((count(*) FILTER (abs(dv - 1) >= abs(di - 1) - 1e-12) + 1) / (count(dv) + 1), 6) AS p_value, count(*) AS n_perms_run, count(dv) AS n_perms_valid,
  count(*) FILTER (abs(dv - 1) >= abs(di - 1) - 1e-12) AS n_extreme, 'two-sided' AS tail FROM p, o GROUP BY di""")
def permutation_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(inference.permutation_mc(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2, REPS))


def _boot(stratified: bool) -> str:
    part, name, on = ("PARTITION BY grp ", "grp || ':' || ", "AND d.grp = x.grp") if stratified else ("", "'all:' || ", "")
    return f"""f AS (SELECT * FROM a WHERE grp IN (0, 1)), x AS (SELECT id, grp, score, row_number() OVER ({part}ORDER BY md5('0:' || id)) - 1 AS pos, count(*) OVER ({part}) AS m FROM f),
d AS (SELECT rep, grp, pos AS j, ('0x' || substr(md5('0:' || rep || ':' || {name}pos), 1, 7))::BIGINT % m AS pos FROM x, (SELECT unnest(range(0, {REPS})) AS rep)),
t AS (SELECT d.rep, d.j, x.grp, x.score FROM d JOIN x ON d.pos = x.pos {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY score DESC NULLS LAST, md5('0:' || rep || ':' || grp || ':' || j)) AS rk, count(*) OVER (PARTITION BY rep) AS n FROM t),
p AS (SELECT rep, avg((rk <= greatest(1, round_even(0.2 * n, 0)))::INT::DOUBLE) FILTER (grp = 0) AS r0, avg((rk <= greatest(1, round_even(0.2 * n, 0)))::INT::DOUBLE) FILTER (grp = 1) AS r1 FROM r GROUP BY rep),
b AS (SELECT r0 / nullif(r1, 0) AS di FROM p)"""


_CI = "round(quantile_cont(di, 0.5), 6) AS point, round(avg(di), 6) AS mean, round(quantile_cont(di, 0.025), 6) AS ci_lo, round(quantile_cont(di, 0.975), 6) AS ci_hi, count(di) AS n_reps"


@query(f"WITH {APPLICANTS}, {_boot(True)} SELECT {_CI} FROM b")
def bootstrap_di_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(inference.bootstrap_di(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2, REPS))


@query(f"WITH {APPLICANTS}, {_boot(False)} SELECT {_CI} FROM b")
def bootstrap_di_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(inference.bootstrap_di(applicants(spark, sf_dir), "score", "grp", ["id"], 0.2, REPS, stratified=False))


@query(f"""WITH {APPLICANTS}, f AS (SELECT id, grp, score AS s0, round(score / 1000.0::DOUBLE) AS s1 FROM a WHERE grp IN (0, 1)),
d AS (SELECT rep, id, grp, s0, s1, rep >= 0 AND ('0x' || substr(md5('0:flip:' || rep || ':' || id), 1, 7))::BIGINT % 2 = 1 AS flip FROM f, (SELECT unnest(range(-1, {REPS})) AS rep)),
u AS (SELECT rep, 0 AS side, id, grp, CASE WHEN flip THEN s1 ELSE s0 END AS score FROM d UNION ALL SELECT rep, 1, id, grp, CASE WHEN flip THEN s0 ELSE s1 END FROM d),
{sel('u', 0.2, cells='rep, side')}, r AS (SELECT rep, side, {RATES} FROM s GROUP BY rep, side),
p AS (SELECT rep, max(r0 / nullif(r1, 0)) FILTER (side = 0) AS d0, max(r0 / nullif(r1, 0)) FILTER (side = 1) AS d1 FROM r GROUP BY rep),
o AS (SELECT d0, d1, d1 - d0 AS delta FROM p WHERE rep = -1), q AS (SELECT p.d1 - p.d0 AS delta, o.delta AS seen, o.d0 AS b0, o.d1 AS b1 FROM p, o WHERE rep >= 0)
SELECT round(b0, 6) AS baseline_di, round(b1, 6) AS mitigated_di, round(seen, 6) + 0.0 AS delta_observed, count(*) AS n_perms_run, count(delta) AS n_perms_valid,
  count(*) FILTER (abs(delta) >= abs(seen) - 1e-12) AS n_extreme, round((count(*) FILTER (abs(delta) >= abs(seen) - 1e-12) + 1) / (count(delta) + 1), 6) AS p_value FROM q GROUP BY b0, b1, seen""")
def paired_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applicants(spark, sf_dir).withColumn("rough", F.round(F.col("score") / 1000.0))
    return r6(inference.paired_permutation(rows, "score", "rough", "grp", ["id"], 0.2, REPS))


#: Two scores and two axes of customers.
AXES = {
    "segment": {"group_0_label": "goods", "group_1_label": "cars", "group_0_values": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "group_1_values": ["AUTOMOBILE"]},
    "half": {"group_0_label": "even", "group_1_label": "odd", "group_0_values": ["0"], "group_1_values": ["1"]},
}
SCORES = ("score", "inverse")


def cells_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).select("id", "score", (-F.col("score")).alias("inverse"), "segment", (F.col("nation") % 2).cast("string").alias("half"))


_CELLS = f"""{APPLICANTS}, ww AS (SELECT id, nation, segment, unnest(['score', 'inverse']) AS score_col, unnest([score, -score]) AS score FROM a),
{sel('ww', 0.2, cells='score_col')},
x AS (SELECT score_col, 'segment' AS axis, id, score, selected, CASE WHEN segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 0 WHEN segment = 'AUTOMOBILE' THEN 1 ELSE -1 END AS grp FROM s
  UNION ALL SELECT score_col, 'half', id, score, selected, (nation % 2)::INT FROM s),
r AS (SELECT score_col, axis, {RATES} FROM x GROUP BY ALL)"""
_AXIS_ROW = "score_col, axis, n_group0, n_group1, round(r0, 6) AS selection_rate_group0, round(r1, 6) AS selection_rate_group1, round(r0 / nullif(r1, 0), 6) AS disparate_impact, round(r0 - r1, 6) + 0.0 AS statistical_parity_difference"


@query(f"""WITH {_CELLS} SELECT {_AXIS_ROW}, CASE axis WHEN 'segment' THEN 'goods' ELSE 'even' END AS group_0_label, CASE axis WHEN 'segment' THEN 'cars' ELSE 'odd' END AS group_1_label FROM r""")
def axis_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(audits.axis_audit(cells_frame(spark, sf_dir), SCORES, {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES))


@query(f"""WITH {_CELLS}, h AS (SELECT score_col || '|' || axis AS cell, id, score, grp FROM x), {_exact_sql('h', 'cell, ').replace('s AS (SELECT', 's2 AS (SELECT').replace('FROM s GROUP', 'FROM s2 GROUP')}
SELECT split_part(cell, '|', 1) AS score_col, split_part(cell, '|', 2) AS axis, round(di, 6) AS observed_di, round(sum(CASE WHEN abs(dv - 1) >= abs(di - 1) - 1e-12 THEN wt END) / sum(CASE WHEN dv IS NOT NULL THEN wt END), 6) AS p_value FROM m GROUP BY cell, di""")
def axis_audit_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audits.axis_permutation(cells_frame(spark, sf_dir), SCORES, {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES)
    return r6(got).select("score_col", "axis", "observed_di", "p_value")


def _boot_cells() -> str:
    return f"""{_CELLS}, f AS (SELECT score_col, axis, id, grp, score FROM x WHERE grp IN (0, 1)),
y AS (SELECT *, row_number() OVER (PARTITION BY score_col, axis, grp ORDER BY md5('0:' || id)) - 1 AS pos, count(*) OVER (PARTITION BY score_col, axis, grp) AS m FROM f),
d AS (SELECT rep, score_col, axis, grp, pos AS j, ('0x' || substr(md5('0:' || rep || ':' || score_col || ':' || axis || ':' || grp || ':' || pos), 1, 7))::BIGINT % m AS pos FROM y, (SELECT unnest(range(0, {CELL_REPS})) AS rep)),
t AS (SELECT d.rep, d.j, d.score_col, d.axis, y.grp, y.score FROM d JOIN y USING (score_col, axis, grp, pos)),
k AS (SELECT *, row_number() OVER (PARTITION BY score_col, axis, rep ORDER BY score DESC NULLS LAST, md5('0:' || rep || ':' || grp || ':' || j)) AS rk, count(*) OVER (PARTITION BY score_col, axis, rep) AS n FROM t),
p AS (SELECT score_col, axis, rep, avg((rk <= greatest(1, round_even(0.2 * n, 0)))::INT::DOUBLE) FILTER (grp = 0) AS r0, avg((rk <= greatest(1, round_even(0.2 * n, 0)))::INT::DOUBLE) FILTER (grp = 1) AS r1 FROM k GROUP BY ALL),
b AS (SELECT score_col, axis, r0 / nullif(r1, 0) AS di FROM p)"""


@query(f"WITH {_boot_cells()} SELECT score_col, axis, {_CI} FROM b GROUP BY ALL")
def rebootstrap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audits.axis_bootstrap(cells_frame(spark, sf_dir), SCORES, {"segment": "segment", "half": "half"}, ["id"], 0.2, CELL_REPS, AXES)
    return r6(got)


@query(f"""WITH {APPLICANTS}, w AS (SELECT *, round(score / 1000.0::DOUBLE) AS rough FROM a), {sel('w', 0.2, name='s0')}, {sel('w', 0.2, name='s1', order='rough')},
b AS (SELECT avg(selected::DOUBLE) FILTER (grp = 0) / nullif(avg(selected::DOUBLE) FILTER (grp = 1), 0) AS d0 FROM s0), c AS (SELECT avg(selected::DOUBLE) FILTER (grp = 0) / nullif(avg(selected::DOUBLE) FILTER (grp = 1), 0) AS d1 FROM s1)
SELECT 'segment' AS axis, round(d0, 6) AS baseline_di, round(d1, 6) AS mitigated_di, round(d1 - d0, 6) + 0.0 AS delta_di FROM b, c""")
def mitigation_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applicants(spark, sf_dir).withColumn("rough", F.round(F.col("score") / 1000.0))
    return r6(audits.mitigation_effect(rows, "score", "rough", {"segment": "segment"}, ["id"], 0.2, {"segment": AXES["segment"]}))


@query(f"""WITH {APPLICANTS}, {sel('a', 0.2)}, z AS (SELECT date_trunc('month', o_orderdate) AS m, grp, selected FROM orders JOIN s ON o_custkey = id), r AS (SELECT m, {RATES} FROM z GROUP BY m)
SELECT strftime(m, '%Y-%m') AS month, n_group0, n_group1, round(r0 / nullif(r1, 0), 6) AS disparate_impact FROM r""")
def monthly_order_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selection.top_k(applicants(spark, sf_dir), "score", ["id"], 0.2).select("id", "grp", "selected")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    got = selection.group_rates(orders.join(chosen, F.col("o_custkey") == F.col("id")), "grp", "selected", ["month"])
    return got.select("month", "n_group0", "n_group1", rounded(F.col("disparate_impact")).alias("disparate_impact"))


_PAIRS = f"""{APPLICANTS}, w AS (SELECT id, nation, segment, unnest(['direct', 'inverse']) AS score_col, unnest([score, -score]) AS s0, unnest([round(score / 1000.0::DOUBLE), -round(score / 500.0::DOUBLE)]) AS s1 FROM a),
x AS (SELECT score_col, 'segment' AS axis, id, s0, s1, CASE WHEN segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 0 WHEN segment = 'AUTOMOBILE' THEN 1 ELSE -1 END AS grp FROM w
  UNION ALL SELECT score_col, 'half', id, s0, s1, (nation % 2)::INT FROM w),
d AS (SELECT rep, score_col, axis, id, grp, s0, s1, rep >= 0 AND ('0x' || substr(md5('0:flip:' || rep || ':' || id), 1, 7))::BIGINT % 2 = 1 AS flip FROM x, (SELECT unnest(range(-1, {CELL_REPS})) AS rep) WHERE grp IN (0, 1)),
u AS (SELECT score_col, axis, rep, 0 AS side, id, grp, CASE WHEN flip THEN s1 ELSE s0 END AS score FROM d UNION ALL SELECT score_col, axis, rep, 1, id, grp, CASE WHEN flip THEN s0 ELSE s1 END FROM d),
{sel('u', 0.2, cells='score_col, axis, rep, side')}, r AS (SELECT score_col, axis, rep, side, {RATES} FROM s GROUP BY ALL),
p AS (SELECT score_col, axis, rep, max(r0 / nullif(r1, 0)) FILTER (side = 0) AS d0, max(r0 / nullif(r1, 0)) FILTER (side = 1) AS d1 FROM r GROUP BY ALL),
o AS (SELECT score_col, axis, d0 AS b0, d1 AS b1, d1 - d0 AS seen FROM p WHERE rep = -1),
k AS (SELECT score_col, axis, b0, b1, seen, count(*) AS n_perms_run, count(d1 - d0) AS n_perms_valid, count(*) FILTER (abs(d1 - d0) >= abs(seen) - 1e-12) AS n_extreme FROM p JOIN o USING (score_col, axis) WHERE rep >= 0 GROUP BY ALL)"""


def pairs_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions of a decomposition: scores, and coarser ones as if stripped."""
    s = F.col("score")
    rows = applicants(spark, sf_dir).select("id", "segment", (F.col("nation") % 2).cast("string").alias("half"), s.alias("direct_original"), (-s).alias("inverse_original"), F.round(s / 1000.0).alias("direct_stripped"), (-F.round(s / 500.0)).alias("inverse_stripped"))
    return rows


@query(f"""WITH {_PAIRS} SELECT score_col, axis, round(b0, 6) AS baseline_di, round(b1, 6) AS mitigated_di, round(seen, 6) + 0.0 AS delta_observed, n_perms_run, n_perms_valid, n_extreme, round((n_extreme + 1) / (n_perms_valid + 1), 6) AS p_value FROM k""")
def paired_permutation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = audits.paired_cells(pairs_frame(spark, sf_dir), {q: (f"{q}_original", f"{q}_stripped") for q in ("direct", "inverse")}, {"segment": "segment", "half": "half"}, ["id"], AXES)
    return r6(inference.paired_permutation(pairs, "before", "after", "grp", ["id"], 0.2, CELL_REPS, cells=["score_col", "axis"]))


@query(f"""WITH {_PAIRS}, {sel('w', 0.2, cells='score_col', name='t0', order='s0')}, {sel('w', 0.2, cells='score_col', name='t1', order='s1')},
y AS (SELECT x.score_col, x.axis, avg(t0.selected::DOUBLE) FILTER (grp = 0) / nullif(avg(t0.selected::DOUBLE) FILTER (grp = 1), 0) AS o0, avg(t1.selected::DOUBLE) FILTER (grp = 0) / nullif(avg(t1.selected::DOUBLE) FILTER (grp = 1), 0) AS o1
  FROM x JOIN t0 USING (score_col, id) JOIN t1 USING (score_col, id) GROUP BY x.score_col, x.axis)
SELECT y.score_col AS question, y.axis, round(o0, 6) AS original_di, round(o1, 6) AS stripped_di, round(o1 - o0, 6) + 0.0 AS delta_di,
  CASE WHEN o0 IS NULL OR o1 IS NULL THEN 'n/a' WHEN abs(o0 - 1) < 0.1::DOUBLE THEN 'no DI to explain' WHEN abs(o1 - 1) < 0.4::DOUBLE * abs(o0 - 1) THEN 'marker-driven' WHEN abs(o1 - 1) > 0.7::DOUBLE * abs(o0 - 1) THEN 'content-driven' ELSE 'mixed' END AS label,
  round(seen, 6) + 0.0 AS paired_delta, round((n_extreme + 1) / (n_perms_valid + 1), 6) AS p_value, n_perms_valid FROM y JOIN k USING (score_col, axis)""")
def decomposition_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audits.decomposition(pairs_frame(spark, sf_dir), ["direct", "inverse"], {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES, n_permutations=CELL_REPS)
    return r6(got)
