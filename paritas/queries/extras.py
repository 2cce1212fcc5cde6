"""Joins, prompts, labels, densities and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions import texts
from paritas.functions.scalars import clip, logit, rounded, stratum_key, stratum_label
from paritas.operators import documents
from paritas.plans import audits
from paritas.queries.inference import _AXIS_ROW, _CELLS, AXES, SCORES, cells_frame
from paritas.queries.roles import EVALUATED, evaluated, table
from paritas.queries.selection import r6
from paritas.queries.texts import LEXICON

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def corpus_scores_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return documents.join_scores(docs, table(spark, sf_dir, "labels"), "doc_id")[0]


@query("""SELECT 'scores' AS "table", count(*) - count(l.doc_id) AS unmatched FROM documents LEFT JOIN labels l USING (doc_id) UNION ALL
SELECT 'stripped', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def corpus_scores_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return documents.join_scores(docs, labels.select("doc_id", "quality"), "doc_id", stripped=labels.where("quality = 1").select("doc_id", "toxic"))[1]


@query("SELECT c_custkey AS id, c_acctbal AS before, round(c_acctbal / 1000.0::DOUBLE) + 0.0 AS after FROM customer")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a, b = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("before")), c.select(F.col("c_custkey").alias("id"), rounded(F.col("c_acctbal") / 1000.0, 0).alias("after"))
    return documents.aligned(a, b, "id")


@query(f"""SELECT c_custkey AS id, replace(replace(replace(replace('{texts.PROMPTS['original']}', '{{seed}}', c_mktsegment), '{{race}}', n_name), '{{gender}}', 'any'), '{{school_tier}}', r_name) AS prompt,
  translate(c_mktsegment || '_' || n_name || '_' || r_name, '/ ', '__') AS stratum_label, c_mktsegment || '|' || n_name || '|' || r_name AS stratum_key
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [F.col(c) for c in ("c_mktsegment", "n_name", "r_name")]
    prompt = texts.build_prompt(seed=parts[0], race=parts[1], gender=F.lit("any"), school_tier=parts[2])
    return rows.select(F.col("c_custkey").alias("id"), prompt.alias("prompt"), stratum_label(*parts).alias("stratum_label"), stratum_key(*parts).alias("stratum_key"))


@query(f"WITH {EVALUATED} SELECT id, round(ln(greatest(1e-6, least(1 - 1e-6, proba)) / (1 - greatest(1e-6, least(1 - 1e-6, proba)))), 6) + 0.0 AS logit, round(greatest(-1.0, least(1.0, proba * 3 - 1.5)), 6) + 0.0 AS clipped FROM e")
def clipped_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("id", rounded(logit(F.col("proba"))).alias("logit"), rounded(clip(F.col("proba") * 3 - 1.5)).alias("clipped"))


@query("SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') AS shown FROM documents")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.display(F.col("text")).alias("shown"))


_LEX = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON) + ") AS x(word, valence))"


@query(f"""WITH {_LEX}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}'']+')) AS word FROM documents), v AS (SELECT doc_id, coalesce(valence, 0) AS v FROM w LEFT JOIN l USING (word)),
s AS (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS m, count(CASE WHEN v = 0 THEN 1 END) AS z FROM v GROUP BY doc_id)
SELECT doc_id, round(coalesce(m / (p + m + z), 0), 6) AS neg, round(coalesce(z / (p + m + z), 1), 6) AS neu, round(coalesce(p / (p + m + z), 0), 6) AS pos, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 6) + 0.0 AS compound FROM documents LEFT JOIN s USING (doc_id)""")
def lexicon_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(LEXICON), "word string, valence double")
    return r6(documents.lexicon_scores(F.col("text"), lexicon, table(spark, sf_dir, "documents"), "doc_id"))


@query("""WITH x AS (SELECT lang, source, len(regexp_extract_all(text, '(?i)the')) AS hits, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM documents),
d AS (SELECT lang, source, 100.0::DOUBLE * hits / nullif(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END, 0) AS d FROM x)
SELECT lang, round(avg(d) FILTER (source = 'src1'), 6) AS top, round(avg(d) FILTER (source = 'src2'), 6) AS low, round(avg(d) FILTER (source = 'src1') / nullif(avg(d) FILTER (source = 'src2'), 0), 6) AS ratio FROM d GROUP BY lang""")
def token_density_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(documents.density_ratio(table(spark, sf_dir, "documents"), "text", "the", "source", "lang", "src1", "src2"))


@query(f"""WITH {_CELLS}, q AS (SELECT {_AXIS_ROW} FROM r) SELECT score_col, axis, unnest(['group0', 'group1']) AS "group", unnest([selection_rate_group0, selection_rate_group1]) AS selection_rate, disparate_impact,
  disparate_impact >= 0.8 AND disparate_impact <= 1.25 AS passes FROM q""")
def figure_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(audits.bars(audits.axis_audit(cells_frame(spark, sf_dir), SCORES, {"segment": "segment", "half": "half"}, ["id"], 0.2, AXES)))


@query("""WITH q AS (SELECT c_mktsegment AS segment, round(quantile_cont(c_acctbal, 0.5), 6) AS point, round(quantile_cont(c_acctbal, 0.025), 6) AS ci_lo, round(quantile_cont(c_acctbal, 0.975), 6) AS ci_hi FROM customer GROUP BY 1)
SELECT (row_number() OVER (ORDER BY point, segment))::INT AS position, * FROM q""")
def figure_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritas.operators.metrics import percentile_interval

    got = percentile_interval(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal"), "c_acctbal", ["segment"])
    return r6(audits.forest(got, "segment"))


@query("""SELECT lang, source, count(*) AS n, count(DISTINCT text) AS n_texts FROM documents GROUP BY ALL""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_texts"))
