"""The synthetic-applicant simulator: draws, scorers, splits and interventions, replayed by SQL from the same hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.scalars import four_fifths, rounded
from paritas.operators import selection
from paritas.operators import simulation as sim
from paritas.operators.metrics import percentile_interval
from paritas.plans import audits, simulations
from paritas.queries.inference import _AXIS_ROW, _CELLS, AXES, SCORES, cells_frame
from paritas.queries.roles import table
from paritas.queries.selection import r6

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


SEEDS = ("control_neutral", "poverty_signal", "illness_signal", "immigration_signal")
RACES, GENDERS, TIERS = ("White", "Black", "Hispanic/Latino", "Asian"), ("Female", "Male"), ("top_20", "mid_tier", "lower_tier")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH s AS (SELECT unnest({_list(SEEDS)}) AS seed_key, unnest(range(0, 4)) AS a), r AS (SELECT unnest({_list(RACES)}) AS race, unnest(range(0, 4)) AS b), g AS (SELECT unnest({_list(GENDERS)}) AS gender, unnest(range(0, 2)) AS c),
t AS (SELECT unnest({_list(TIERS)}) AS school_tier, unnest(range(0, 3)) AS d), i AS (SELECT unnest(range(1, 5)) AS instance)
SELECT 'PS' || lpad((row_number() OVER (ORDER BY a, b, c, d, instance))::VARCHAR, 4, '0') AS applicant_id, seed_key, race, gender, school_tier, instance::INT AS instance FROM s, r, g, t, i""")
def corpus_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.corpus_grid(spark, SEEDS, RACES, GENDERS, TIERS, 4)


def _unit(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 7))::BIGINT)"


def _normal(mean: str, sd: float, at: str, name: str) -> str:
    return f"({mean} + {sd}::DOUBLE * sqrt(-2.0::DOUBLE * ln(({_unit(at, repr(name), repr('u'))} + 1) / 268435457.0::DOUBLE)) * cos(2.0::DOUBLE * 3.141592653589793::DOUBLE * ({_unit(at, repr(name), repr('v'))} / 268435456.0::DOUBLE)))"


def _poisson(at: str) -> str:
    import math

    total, term, steps = 0.0, math.exp(-sim.RATE), []
    for k in range(30):
        total += term
        term *= sim.RATE / (k + 1)
        steps.append(total)
    u = f"({_unit(at, repr('publications'))} / 268435456.0::DOUBLE)"
    return f"list_sum(list_transform([{', '.join(f'{x!r}::DOUBLE' for x in steps)}], lambda x: CASE WHEN {u} >= x THEN 1 ELSE 0 END))::INT"


def _people(ids: str, at: str, low: str, high: str, sd: float, keep: str = "", name: str = "p") -> str:
    """SQL of the generated applicants over ``ids`` (columns id and those of ``keep``)."""
    half = "/ 268435456.0::DOUBLE"
    return f"""{name}0 AS (SELECT *, CASE WHEN {_unit(at, "'group'")} {half} < 0.5 THEN 0 ELSE 1 END AS grp FROM {ids}),
{name}1 AS (SELECT *, {', '.join(f'{_normal(f"{m}::DOUBLE", s, at, f)} AS {f}' for f, (m, s) in sim.NORMALS.items())}, {_poisson(at)} AS publications,
  greatest(-1.0, least(1.0, {_normal(f'CASE WHEN grp = 0 THEN {low} ELSE {high} END', sd, at, 'sentiment')})) AS narrative_sentiment FROM {name}0),
{name} AS (SELECT *, CASE WHEN {_unit(at, "'label'")} {half} < {LINEAR} THEN 1 ELSE 0 END AS label FROM {name}1)"""


_PARTS = [f"{sim.BETAS[f]}::DOUBLE * " + (f"({f} - {sim.CENTRES[f]}::DOUBLE)" if f in sim.CENTRES else f) for f in sim.FEATURES]
LINEAR = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({' + '.join(_PARTS)}))))"


def _power(p: int) -> str:
    return "(1.0::DOUBLE / (1.0::DOUBLE + exp(-(" + " + ".join(f"sign({c}) * pow(abs({c}), {p}.0::DOUBLE)" for c in _PARTS) + "))))"


#: Applicants are numbered by customers, so the simulation grows with the data.
_IDS = "i AS (SELECT c_custkey AS id FROM customer)"
_BASE = f"WITH {_IDS}, {_people('i', '42, id', '0.18::DOUBLE', '0.78::DOUBLE', 0.3)}"
_ROUND = ", ".join(f"round({f}, 5) + 0.0 AS {f}" if f != "publications" else f for f in sim.FEATURES)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.applicants(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 42, 0.18, 0.78, 0.3)


@query(f"{_BASE} SELECT id, grp, {_ROUND}, label FROM p")
def dgp_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = people(spark, sf_dir).withColumnRenamed("group", "grp")
    return rows.select("id", "grp", *(F.col(f) if f == "publications" else rounded(F.col(f), 5).alias(f) for f in sim.FEATURES), "label")


@query(f"""{_BASE}, x AS (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY md5('0:' || id)) AS rk, count(*) OVER (PARTITION BY grp, label) AS n FROM p)
SELECT id, grp, label, rk <= greatest(0, round_even(0.3 * n, 0)) AS is_test FROM x""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sim.stratified_split(people(spark, sf_dir), ["group", "label"], ["id"])
    return rows.select("id", F.col("group").alias("grp"), "label", "is_test")


@query(f"{_BASE} SELECT id, round({LINEAR}, 6) AS proba FROM p")
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("id", rounded(sim.linear_score()).alias("proba"))


@query(f"{_BASE} SELECT id, round({_power(2)}, 6) AS proba FROM p")
def power_aggregation_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("id", rounded(sim.power_score(2)).alias("proba"))


@query(f"{_BASE} SELECT id, round({_power(3)}, 6) AS proba FROM p")
def power_aggregation_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("id", rounded(sim.power_score(3)).alias("proba"))


_CF = "greatest(-1.0, least(1.0, " + _normal("0.78::DOUBLE", 0.3, "7919, 'cf', id", "") + "))"
_CF = _CF.replace(", '', 'u'", ", 'u'").replace(", '', 'v'", ", 'v'")


@query(f"{_BASE} SELECT id, grp, round(CASE WHEN grp = 0 THEN {_CF} ELSE narrative_sentiment END, 5) + 0.0 AS narrative_sentiment FROM p")
def counterfactual_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sim.counterfactual(people(spark, sf_dir), 0.78, 0.3, 7919)
    return rows.select("id", F.col("group").alias("grp"), rounded(F.col("narrative_sentiment"), 5).alias("narrative_sentiment"))


_RATES = ", ".join(f"{r}::DOUBLE" for r in sim.DISCLOSURE_RATES)
_DISC = f"""{_BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('7919:disclose:' || id)) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM p),
d AS (SELECT id, grp, rate, score_a, publications, score_b, score_c, score_d, CASE WHEN grp = 0 AND rk <= round_even(rate * n, 0) THEN {_CF} ELSE narrative_sentiment END AS narrative_sentiment,
  CASE WHEN grp = 0 AND rk <= round_even(rate * n, 0) THEN 1 ELSE 0 END AS disclosed FROM k, (SELECT unnest([{_RATES}]) AS rate)),
s AS (SELECT *, {LINEAR} AS proba FROM d), t AS (SELECT *, row_number() OVER (PARTITION BY rate ORDER BY proba DESC, id) AS pl, count(*) OVER (PARTITION BY rate) AS m FROM s),
y AS (SELECT *, CASE WHEN pl <= round_even(0.12 * m, 0) THEN 1.0::DOUBLE ELSE 0 END AS yhat FROM t),
r AS (SELECT rate, sum(disclosed)::BIGINT AS n_disclosed, avg(yhat) FILTER (grp = 0) AS r0, avg(yhat) FILTER (grp = 1) AS r1 FROM y GROUP BY rate)"""


def disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sim.disclosure(people(spark, sf_dir), sim.DISCLOSURE_RATES, 0.78, 0.3, 7919).withColumn("proba", sim.linear_score())
    chosen = selection.rank_replicates(rows, "proba", "id", 0.12, ["rate"])
    n = chosen.groupBy("rate").agg(F.sum("disclosed").cast("long").alias("n_disclosed"))
    return selection.group_rates(chosen, "group", "yhat", ["rate"]).join(n, "rate")


@query(f"{_DISC} SELECT rate, n_disclosed, round(r0, 6) AS selection_rate_group0, round(r1, 6) AS selection_rate_group1, round(r0 / nullif(r1, 0), 6) AS disparate_impact FROM r")
def disclosure_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(disclosed(spark, sf_dir)).select("rate", "n_disclosed", "selection_rate_group0", "selection_rate_group1", "disparate_impact")


@query(f"{_DISC} SELECT round(rate * 100, 6) AS rate_pct, round(r0 / nullif(r1, 0), 6) AS disparate_impact, r0 / nullif(r1, 0) >= 0.8 AS passes FROM r")
def figure_disclosure_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = disclosed(spark, sf_dir)
    return rows.select(rounded(F.col("rate") * 100).alias("rate_pct"), rounded(F.col("disparate_impact")).alias("disparate_impact"), four_fifths(F.col("disparate_impact")).alias("passes"))


REPS = 5
_ANCH = "n AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {lo}::DOUBLE, {hi}::DOUBLE)" for a, lo, hi in sim.ANCHORINGS) + ") AS x(anchoring, low, high))"
_SWEEP_IDS = f"{_ANCH}, i AS (SELECT c_custkey AS id, rep, anchoring, low, high FROM customer, n, (SELECT unnest(range(0, {REPS})) AS rep))"


@query(f"""WITH {_SWEEP_IDS}, {_people('i', '42, rep, id', 'low', 'high', 0.3)}, s AS (SELECT anchoring, rep, grp, id, {LINEAR} AS proba FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY anchoring, rep ORDER BY proba DESC, id) AS pl, count(*) OVER (PARTITION BY anchoring, rep) AS m FROM s),
r AS (SELECT anchoring, rep, avg((pl <= round_even(0.12 * m, 0))::INT::DOUBLE) FILTER (grp = 0) / nullif(avg((pl <= round_even(0.12 * m, 0))::INT::DOUBLE) FILTER (grp = 1), 0) AS di FROM t GROUP BY ALL)
SELECT anchoring, round(quantile_cont(di, 0.5), 6) AS point, round(avg(di), 6) AS mean, round(quantile_cont(di, 0.025), 6) AS ci_lo, round(quantile_cont(di, 0.975), 6) AS ci_hi, count(di) AS n_reps FROM r GROUP BY anchoring""")
def anchoring_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchoring and repetition in one plan, scored by the true weights."""
    anchorings = F.broadcast(spark.createDataFrame(list(sim.ANCHORINGS), "anchoring string, low double, high double"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).crossJoin(anchorings).crossJoin(F.broadcast(spark.range(REPS).withColumnRenamed("id", "rep")))
    rows = sim.applicants(ids, 42, F.col("low"), F.col("high"), 0.3, F.col("rep")).withColumn("proba", sim.linear_score())
    chosen = selection.rank_replicates(rows, "proba", "id", 0.12, ["anchoring", "rep"])
    per = selection.group_rates(chosen, "group", "yhat", ["anchoring", "rep"])
    return r6(percentile_interval(per, "disparate_impact", ["anchoring"]))


_INTERVAL = "round(quantile_cont(di, 0.5), 6) + 0.0 AS point, round(avg(di), 6) + 0.0 AS mean, round(quantile_cont(di, 0.025), 6) + 0.0 AS ci_lo, round(quantile_cont(di, 0.975), 6) + 0.0 AS ci_hi, count(di) AS n_reps"


def _tested(source: str, cells: str, seed: int, invite: float, keep: str) -> str:
    """SQL of the test rows of replicates: split by stratum, scored, the first ``invite`` of them chosen (``yh``)."""
    return f"""x AS (SELECT *, row_number() OVER (PARTITION BY {cells}, grp, label ORDER BY md5('{seed}:' || id)) AS rk, count(*) OVER (PARTITION BY {cells}, grp, label) AS n FROM {source}),
s AS (SELECT {cells}, grp, id, label, {LINEAR} AS proba FROM x WHERE rk <= greatest(0, round_even(0.3 * n, 0))),
t AS (SELECT *, row_number() OVER (PARTITION BY {cells} ORDER BY proba DESC, id) AS pl, count(*) OVER (PARTITION BY {cells}) AS m FROM s),
y AS (SELECT *, (pl <= round_even({invite} * m, 0))::INT::DOUBLE AS yh FROM t), r AS (SELECT {cells}, avg(yh) FILTER (grp = 0) AS a, avg(yh) FILTER (grp = 1) AS b{keep} FROM y GROUP BY ALL)"""


_RATE = "avg(yh) FILTER (grp = 0 AND label = {0}) - avg(yh) FILTER (grp = 1 AND label = {0})"


@query(f"""WITH {_SWEEP_IDS}, {_people('i', "42, anchoring || '/' || rep, id", 'low', 'high', 0.3)},
{_tested('p', 'anchoring, rep', 42, 0.3, f", {_RATE.format(1)} AS eod, {_RATE.format(0)} AS fpd, avg((label = yh)::INT::DOUBLE) AS acc")},
l AS (SELECT anchoring, unnest({_list(simulations.METRICS)}) AS metric, unnest([a / nullif(b, 0), a - b, eod, fpd, a, b, acc]) AS di FROM r) SELECT anchoring, metric, {_INTERVAL} FROM l GROUP BY ALL""")
def screening_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven metrics of screenings on held-out applicants, with intervals over replicates, for every anchoring."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return r6(simulations.screening(spark, reps=REPS, model="linear_score", ids=ids))


_AT = sim.ANCHORINGS[0]
_REDRAWN = _normal(f"{float(_AT[2])!r}::DOUBLE", 0.3, "99991, 'cf', id", "").replace(", '', 'u'", ", 'u'").replace(", '', 'v'", ", 'v'")
_FEATURES = ", ".join(f for f in sim.FEATURES if f != "narrative_sentiment")


@query(f"""WITH i AS (SELECT c_custkey AS id, rep FROM customer, (SELECT unnest(range(0, {REPS})) AS rep)), {_people('i', f"0, '{_AT[0]}/' || rep, id", f'{float(_AT[1])!r}::DOUBLE', f'{float(_AT[2])!r}::DOUBLE', 0.3)},
k AS (SELECT *, row_number() OVER (PARTITION BY rep, grp ORDER BY md5('99991:disclose:' || id)) AS dk, count(*) OVER (PARTITION BY rep, grp) AS dn FROM p),
d AS (SELECT id, rep, rate, grp, label, {_FEATURES}, CASE WHEN grp = 0 AND dk <= round_even(rate * dn, 0) THEN greatest(-1.0, least(1.0, {_REDRAWN})) ELSE narrative_sentiment END AS narrative_sentiment FROM k, (SELECT unnest([{_RATES}]) AS rate)),
{_tested('d', 'rate, rep', 0, 0.12, '')},
l AS (SELECT rate, unnest(['disparate_impact', 'selection_rate_group0', 'selection_rate_group1']) AS metric, unnest([a / nullif(b, 0), a, b]) AS di FROM r) SELECT rate, metric, {_INTERVAL} FROM l GROUP BY ALL""")
def disclosure_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio and the selection rates by rate of disclosure, with intervals over replicates."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return r6(simulations.disclosure_sweep(spark, _AT, reps=REPS, ids=ids))


@query(f"WITH {_CELLS}, q AS (SELECT {_AXIS_ROW} FROM r) SELECT score_col, max(disparate_impact) FILTER (axis = 'segment') AS segment, max(disparate_impact) FILTER (axis = 'half') AS half FROM q GROUP BY score_col")
def figure_heatmap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = audits.axis_audit(cells_frame(spark, sf_dir), SCORES, {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES)
    return r6(audits.heatmap(audit, axes=["segment", "half"]))


_DEC = _CELLS.replace("['score', 'inverse']", "['q_original', 'q_stripped']").replace("[score, -score]", "[score, round(score / 1000.0::DOUBLE)]")


@query(f"""WITH {_DEC}, q AS (SELECT axis, max(r0 / nullif(r1, 0)) FILTER (score_col = 'q_original') AS o, max(r0 / nullif(r1, 0)) FILTER (score_col = 'q_stripped') AS s FROM r GROUP BY axis)
SELECT 'q' AS question, axis, round(o, 6) AS original_di, round(s, 6) AS stripped_di, round(s - o, 6) + 0.0 AS delta_di, CASE WHEN o IS NULL OR s IS NULL THEN 'n/a' WHEN abs(o - 1) < 0.1 THEN 'no DI to explain'
 WHEN abs(s - 1) < 0.4 * abs(o - 1) THEN 'marker-driven' WHEN abs(s - 1) > 0.7 * abs(o - 1) THEN 'content-driven' ELSE 'mixed' END AS label FROM q""")
def counterfactual_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells_frame(spark, sf_dir).withColumns({"q_original": F.col("score"), "q_stripped": F.round(F.col("score") / 1000.0)})
    return r6(audits.decomposition(rows, ["q"], {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES))


@query(f"""WITH {_DEC}, q AS (SELECT axis, score_col, round(r0 / nullif(r1, 0), 6) AS disparate_impact FROM r)
SELECT 'q' AS question, axis, CASE score_col WHEN 'q_original' THEN 'original_di' ELSE 'stripped_di' END AS stage, disparate_impact, CASE score_col WHEN 'q_original' THEN 0 ELSE 1 END AS position FROM q""")
def figure_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells_frame(spark, sf_dir).withColumns({"q_original": F.col("score"), "q_stripped": F.round(F.col("score") / 1000.0)})
    return r6(audits.slopes(audits.decomposition(rows, ["q"], {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES)))


@query("""WITH e AS (SELECT date_trunc('day', ts) AS d, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS grp, (value > 50)::INT::DOUBLE AS s FROM events),
r AS (SELECT d, count(*) FILTER (grp = 0) AS n_group0, count(*) FILTER (grp = 1) AS n_group1, avg(s) FILTER (grp = 0) AS r0, avg(s) FILTER (grp = 1) AS r1 FROM e GROUP BY d)
SELECT strftime(d, '%Y-%m-%d') AS day, n_group0, n_group1, round(r0 / nullif(r1, 0), 6) AS disparate_impact, r0 / nullif(r1, 0) >= 0.8 AS passes FROM r""")
def event_window_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the streaming monitor over a table of events."""
    from paritas.streaming.monitor import windowed_impact

    events = table(spark, sf_dir, "events")
    got = windowed_impact(events, "ts", F.when(F.col("user_id") % 2 == 0, 0).otherwise(1), F.col("value") > 50, "1 day")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.col("n_group0").cast("long").alias("n_group0"), F.col("n_group1").cast("long").alias("n_group1"), rounded(F.col("disparate_impact")).alias("disparate_impact"), "passes")
