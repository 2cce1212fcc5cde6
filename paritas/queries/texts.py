"""Texts: mitigation, splitting, parsing, densities, sections, embeddings and dilution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions import texts
from paritas.functions.scalars import rounded
from paritas.operators import documents
from paritas.plans import audits
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


#: Cases for rules that no shared text exercises; as rows beside the shared texts.
CASES = (
    (-1, "Mr. Smith met Mrs Jones; HER brother and Hers, himself. Miss the bus.", "top_20"),
    (-2, "The African American and Pacific Islander doctors drank black coffee.", "mid_tier"),
    (-3, "She studied at Harvard School of Medicine, then Johns Hopkins and lower-case yale hospital.", "lower_tier"),
    (-4, "A caring, warm and HARDWORKING colleague; meticulous and dedicated.", "top_20"),
    (-5, "", "mid_tier"),
    (-6, None, "lower_tier"),
    (-7, "Iowa is flat. Nothing else here.", "top_20"),
    (-8, "He trained as a physician near Iowa and at Wayne State.", "mid_tier"),
    (-9, "éher and her; prof. Madam Sir dr. Who", "top_20"),
)
_quote = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
CASES_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quote(t)}, '{k}')" for i, t, k in CASES) + ") AS x(id, text, tier))"


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CASES), "id long, text string, tier string")


def sql_rules(column: str, rules) -> str:
    r"""Nested rewrites. A border is marked first (\x01 between a word character and another), so that patterns need no look-around."""
    marked = f"regexp_replace({column}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"
    for pattern, replacement in rules:
        body = pattern
        # a pattern's words are runs between \x01 and \x02 in the marked text
        words = _marked_pattern(body)
        marked = f"regexp_replace({marked}, '{words}', {_mark_sql(replacement)}, 'gi')"
    return f"replace(replace({marked}, chr(1), ''), chr(2), '')"


def _mark_sql(replacement: str) -> str:
    import re

    pieces = re.split(r"([\w]+)", replacement)
    return " || ".join(f"chr(1) || '{p}' || chr(2)" if re.fullmatch(r"\w+", p) else f"'{p}'" for p in pieces if p) or "''"


def _marked_pattern(pattern: str) -> str:
    """The pattern over marked text, for patterns of plain words, blanks, hyphens, alternatives and a final optional dot."""
    import re

    body = pattern.removeprefix(r"\b")
    if body.endswith(r"\.?\b"):  # a dot is only taken where a word follows at once
        word = body.removesuffix(r"\.?\b")
        return f"\\x01{word}\\x02"
    body = body.removesuffix(r"\b")
    body = re.sub(r"\[A-Za-z\]\[a-zA-Z\]\+", "@W@", body)
    body = re.sub(r"\[- \]", "@H@", body)
    tokens = re.split(r"(\(\?:|\)|\||@W@|@H@| |-)", body)
    out = "".join(f"\\x01{t}\\x02" if re.fullmatch(r"\w+", t) else {"@W@": "\\x01[A-Za-z][a-zA-Z]+\\x02", "@H@": "[- ]"}.get(t, t) for t in tokens)
    return out


_DOCS = "d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT id, text FROM c)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(cases(spark).select("id", "text"))


def _hashed(df: DataFrame, text) -> DataFrame:
    return df.select("id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n"))


_T = "coalesce(text, '')"


@query(f"WITH {CASES_SQL}, {_DOCS}, t AS (SELECT id, {sql_rules(_T, texts.PRONOUNS)} AS t FROM d) SELECT id, md5(t) AS text_md5, length(t) AS n FROM t")
def mitigate_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(_texts(spark, sf_dir), texts.apply_rules(F.coalesce("text", F.lit("")), texts.PRONOUNS))


_ALL = [*texts.HONORIFICS, *texts.PRONOUNS, *texts.ETHNICITIES, *texts.SCHOOLS, *texts.SUBSTITUTIONS]


@query(f"WITH {CASES_SQL}, {_DOCS}, t AS (SELECT id, {sql_rules(_T, _ALL)} AS t FROM d) SELECT id, md5(t) AS text_md5, length(t) AS n FROM t")
def mitigate_full_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(_texts(spark, sf_dir), texts.mitigate(F.col("text")))


@query(f"WITH {CASES_SQL}, {_DOCS}, t AS (SELECT id, {sql_rules(_T, texts.HONORIFICS)} AS t FROM d) SELECT id, md5(t) AS text_md5, length(t) AS n FROM t")
def honorific_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(_texts(spark, sf_dir), texts.apply_rules(F.coalesce("text", F.lit("")), texts.HONORIFICS))


@query(f"WITH {CASES_SQL}, {_DOCS}, t AS (SELECT id, {sql_rules(_T, texts.SUBSTITUTIONS)} AS t FROM d) SELECT id, md5(t) AS text_md5, length(t) AS n FROM t")
def semantic_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(_texts(spark, sf_dir), texts.substitute(F.col("text")))


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases, and the documents in turn of each tier, with a sentence on schools at their end."""
    tier = F.element_at(F.array(F.lit("top_20"), F.lit("mid_tier"), F.lit("lower_tier")), (F.col("doc_id") % 3 + 1).cast("int"))
    told = F.element_at(F.array(F.lit(" Residency at Yale, then Wayne State medical school."), F.lit(" Yale is far from Iowa."), F.lit(" Harvard Medical School.")), (F.col("doc_id") % 5 % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", told).alias("text"), tier.alias("tier"))
    return docs.unionByName(cases(spark))


@query()
def tier_school_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts.tier_substitution(F.col("text"), F.col("tier"))
    return tiered(spark, sf_dir).select("id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 15)[1:200] AS l FROM documents)
SELECT doc_id, len(l) AS n_sentences, md5(array_to_string(l, '|')) AS sentences_md5 FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", texts.sentences(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_sentences"), F.md5(F.array_join("l", "|")).alias("sentences_md5"))


#: Turns of a conversation under headers of their role: documents with sections.
_SECTIONED = """v AS (SELECT conv_id, 'opening words of all' || chr(10) || string_agg(upper(role) || ' TURN ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM v),
h AS (SELECT *, trim(line) AS t, (trim(line) = upper(trim(line)) AND length(trim(line)) >= 5 AND regexp_matches(line, '\\p{L}') AND NOT starts_with(trim(line), '-')) AS head FROM x),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM h),
b AS (SELECT conv_id, sec, coalesce(max(CASE WHEN head THEN t END), 'PREAMBLE') AS label, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), ''), ' ' || chr(10) || chr(9)) AS body FROM s GROUP BY conv_id, sec)"""


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    one = F.struct("turn", F.concat(F.upper("role"), F.lit(" TURN "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")).alias("t"))
    return turns.groupBy("conv_id").agg(F.concat(F.lit("opening words of all\n"), F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), "\n")).alias("text"))


@query(f"""WITH {_SECTIONED} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sec)::INT AS pos, label, md5(body) AS body_md5, len(string_split(trim(regexp_replace(body, '[\\s\\p{{Z}}]+', ' ', 'g')), ' ')) AS word_count FROM b WHERE body <> ''""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents.sections(_sectioned(spark, sf_dir), "conv_id", "text")
    return got.select("conv_id", "pos", "label", F.md5("body").alias("body_md5"), "word_count")


@query("""WITH x AS (SELECT conv_id, turn AS pos, role || turn AS label, unnest(['length', 'vowels']) AS instrument, unnest([length(text) % 7, length(regexp_replace(text, '[^aeiou]', '', 'g')) % 5]) AS score FROM conversations),
l AS (SELECT conv_id, instrument, first(label ORDER BY score, pos) AS lowest FROM x GROUP BY ALL)
SELECT conv_id, instrument, lowest, count(*) OVER (PARTITION BY conv_id) >= 2 AND min(lowest) OVER (PARTITION BY conv_id) = max(lowest) OVER (PARTITION BY conv_id) AS unanimous FROM l""")
def rank_lowest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    rows = t.select("conv_id", F.col("turn").alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("label"), (F.length("text") % 7).alias("length"), (F.length(F.regexp_replace("text", "[^aeiou]", "")) % 5).alias("vowels"))
    return documents.rank_lowest(rows.unpivot(["conv_id", "pos", "label"], ["length", "vowels"], "instrument", "score"), "conv_id", 2)


@query("""WITH x AS (SELECT doc_id, lang, len(regexp_extract_all(text, '(?i)the')) AS hits, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, round(100.0::DOUBLE * hits / nullif(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END, 0), 6) AS per_100_words FROM x""")
def token_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rounded(texts.token_density(F.col("text"), "the")).alias("per_100_words"))


ANSWERS = (
    (-1, '{"k": 0.5, "j": 1}'), (-2, 'Sure: {"k": "0.8"} and {"k": 3}'), (-3, "no block"), (-4, '{"k": null, "j": true}'), (-5, '{"a": {"k": 1}}'), (-6, '{"k": broken}'), (-7, None), (-8, '{"j": "x"}'),
)
_ANSWERS_SQL = "VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in ANSWERS)


@query(f"""WITH x AS (SELECT event_id AS id, props AS content FROM events UNION ALL SELECT * FROM ({_ANSWERS_SQL})),
b AS (SELECT id, CASE WHEN json_valid(nullif(regexp_extract(content, '\\{{[^{{}}]*\\}}', 0), '')) THEN regexp_extract(content, '\\{{[^{{}}]*\\}}', 0) END AS b FROM x)
SELECT id, CASE b->>'k' WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE try_cast(b->>'k' AS DOUBLE) END AS k, CASE b->>'j' WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE try_cast(b->>'j' AS DOUBLE) END AS j FROM b""")
def llm_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("content")).unionByName(spark.createDataFrame(list(ANSWERS), "id long, content string"))
    return rows.select("id", *texts.parse_answers(F.col("content"), ["k", "j"]))


TONES = ((1, '{"compound": -0.4, "rationale": "cold"}'), (2, "hm"), (3, '{"compound": "0.25"}'), (4, '{"rationale": "none"}'))


_TONES_SQL = "VALUES " + ", ".join(f"({-i}, {_quote(t)})" for i, t in TONES)


@query(f"""WITH x AS (SELECT event_id AS id, replace(props, '"k"', '"compound"') AS content FROM events UNION ALL SELECT * FROM ({_TONES_SQL})),
b AS (SELECT id, content, CASE WHEN json_valid(nullif(regexp_extract(content, '\\{{[^{{}}]*\\}}', 0), '')) THEN regexp_extract(content, '\\{{[^{{}}]*\\}}', 0) END AS b FROM x)
SELECT id, CASE b->>'compound' WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE try_cast(b->>'compound' AS DOUBLE) END AS compound,
  CASE WHEN b IS NULL THEN 'PARSE_ERROR: ' || substr(content, 1, 200) ELSE coalesce(b->>'rationale', '') END AS rationale FROM b""")
def tone_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i, t) for i, t in TONES], "id long, content string")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.replace("props", F.lit('"k"'), F.lit('"compound"')).alias("content")).unionByName(own)
    return rows.select("id", *texts.parse_tone(F.col("content")))


@query("SELECT item_id, md5('before ' || text || ' after') AS filled_md5 FROM benchmark")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(texts.fill_template(F.lit("before {VARIANT_PARAGRAPH} after"), F.col("text"))).alias("filled_md5"))


@query("""WITH x AS (SELECT item_id % 4 AS v, item_id % 3 AS i, text FROM benchmark),
s AS (SELECT 'i' || i AS instrument, 'v' || v AS variant, avg(length(text)::DOUBLE) AS excerpt, avg(length(regexp_replace(text, '[aeiou]', '', 'g'))::DOUBLE) AS full_doc FROM x GROUP BY ALL),
p AS (SELECT * FROM (VALUES ('v0', 'v1'), ('v2', 'v3'), ('v0', 'v9')) AS y(low, high))
SELECT h.instrument, high || ' − ' || low AS pair, round(h.excerpt - l.excerpt, 6) + 0.0 AS excerpt_gap, round(h.full_doc - l.full_doc, 6) + 0.0 AS full_doc_gap,
  CASE WHEN abs(h.excerpt - l.excerpt) > 1e-8 THEN round((h.full_doc - l.full_doc) / (h.excerpt - l.excerpt), 6) + 0.0 END AS dilution_ratio
FROM p JOIN s l ON l.variant = low JOIN s h ON h.variant = high AND h.instrument = l.instrument""")
def gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(documents.gap_table(_variants(spark, sf_dir), spark.createDataFrame([("v0", "v1"), ("v2", "v3"), ("v0", "v9")], "low string, high string")))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), (F.col("item_id") % 3).cast("string")).alias("instrument"), F.concat(F.lit("v"), (F.col("item_id") % 4).cast("string")).alias("variant"), "text")
    got = rows.groupBy("instrument", "variant").agg(F.avg(F.length("text").cast("double")).alias("excerpt"), F.avg(F.length(F.regexp_replace("text", "[aeiou]", "")).cast("double")).alias("full_doc"))
    return got.unpivot(["instrument", "variant"], ["excerpt", "full_doc"], "level", "compound")


@query("""WITH x AS (SELECT item_id % 4 AS v, item_id % 3 AS i, text FROM benchmark),
s AS (SELECT 'i' || i AS instrument, 'v' || v AS variant, avg(length(text)::DOUBLE) AS excerpt, avg(length(regexp_replace(text, '[aeiou]', '', 'g'))::DOUBLE) AS full_doc FROM x GROUP BY ALL),
p AS (SELECT * FROM (VALUES ('v0', 'v1'), ('v2', 'v3')) AS y(low, high)),
g AS (SELECT h.instrument, h.excerpt - l.excerpt AS e, h.full_doc - l.full_doc AS f FROM p JOIN s l ON l.variant = low JOIN s h ON h.variant = high AND h.instrument = l.instrument)
SELECT instrument, round(avg(CASE WHEN abs(e) <= 1e-9 THEN 0.0 ELSE 100.0::DOUBLE * (1 - abs(f) / abs(e)) END), 4) AS mean_dilution_pct, count(*) AS n_pairs FROM g GROUP BY instrument""")
def dilution_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents.dilution_percent(documents.gap_table(_variants(spark, sf_dir), spark.createDataFrame([("v0", "v1"), ("v2", "v3")], "low string, high string")))
    return got.select("instrument", rounded(F.col("mean_dilution_pct"), 4).alias("mean_dilution_pct"), "n_pairs")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("seed"), (F.col("vec_id") % 4).cast("string").alias("stratum"), F.col("embedding").alias("vec"))


_PAIRS = """e AS (SELECT vec_id AS id, label AS seed, vec_id % 4 AS stratum, embedding::DOUBLE[] AS vec FROM embeddings),
p AS (SELECT a.seed, CASE WHEN a.seed <> b.seed THEN 'across_seed' WHEN a.stratum = b.stratum THEN 'within_seed_within_stratum' ELSE 'within_seed_across_stratum' END AS level, 1 - list_dot_product(a.vec, b.vec) AS distance FROM e a JOIN e b ON a.id < b.id)"""


@query(f"WITH {_PAIRS} SELECT level, count(*) AS n, round(avg(distance), 5) AS mean, round(quantile_cont(distance, 0.5), 5) AS median, round(quantile_cont(distance, 0.1), 5) AS p10, round(quantile_cont(distance, 0.9), 5) AS p90 FROM p GROUP BY level")
def content_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents.distance_levels(_vectors(spark, sf_dir), "id", "seed", "stratum")
    return got.select("level", "n", *(rounded(F.col(c), 5).alias(c) for c in ("mean", "median", "p10", "p90")))


@query(f"WITH {_PAIRS} SELECT level, count(*) AS n, round(avg(distance), 5) AS mean FROM p GROUP BY level")
def content_equivalence_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.distance_means(_vectors(spark, sf_dir), "id", "seed", "stratum").select("level", "n", rounded(F.col("mean"), 5).alias("mean"))


@query(f"""WITH {_PAIRS}, m AS (SELECT avg(distance) FILTER (level = 'within_seed_across_stratum') AS w, avg(distance) FILTER (level = 'across_seed') AS a FROM p)
SELECT round(w, 5) AS within, round(a, 5) AS across, round(w / a, 5) AS ratio, w < a AS holds, CASE WHEN w / a < 0.7 THEN 'holds constant' WHEN w / a > 0.9 THEN 'meaningful variation' ELSE 'marginal' END AS verdict FROM m""")
def content_equivalence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audits.equivalence_ratio(_vectors(spark, sf_dir), "id", "seed", "stratum")
    return got.select(*(rounded(F.col(c), 5).alias(c) for c in ("within", "across", "ratio")), "holds", "verdict")


#: Questions of the embedding audit: the first vectors of four labels.
def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label < 4")
    return e.groupBy(F.concat(F.lit("q"), F.col("label").cast("string")).alias("question")).agg(F.min_by("embedding", "vec_id").alias("vec"))


def _sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 5)).cast("long").alias("doc_id"), F.col("vec_id").alias("sent_no"), F.col("embedding").alias("vec"))


def _extract_sql(threshold: float, name: str = "") -> str:
    return f"""p{name} AS (SELECT vec_id // 5 AS doc_id, vec_id AS sent, question, list_dot_product(embedding::DOUBLE[], q.vec::DOUBLE[]) AS s FROM embeddings, q),
w{name} AS (SELECT *, max(s) OVER (PARTITION BY doc_id, sent) AS best FROM p{name}), e{name} AS (SELECT *, exp(8.0::DOUBLE * (s - best)) AS e FROM w{name}),
x{name} AS (SELECT *, e / (sum(e) OVER (PARTITION BY doc_id, sent) + 1e-12) AS wt FROM e{name}),
t{name} AS (SELECT doc_id, question, pow(sum(CASE WHEN best >= {threshold} THEN wt * s ELSE 0 END), 2) AS score FROM x{name} GROUP BY ALL),
u{name} AS (SELECT * FROM t{name} UNION ALL SELECT doc_id, '_total', sum(score) FROM t{name} GROUP BY doc_id)"""


_Q = "q AS (SELECT 'q' || label AS question, first(embedding ORDER BY vec_id) AS vec FROM embeddings WHERE label < 4 GROUP BY label)"


@query(f"WITH {_Q}, {_extract_sql(0.35)} SELECT doc_id, question, round(score, 5) AS score FROM u")
def extractor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents.extractor_scores(_sentence_vectors(spark, sf_dir), _questions(spark, sf_dir))
    return got.select("doc_id", "question", rounded(F.col("score"), 5).alias("score"))


@query(f"WITH {_Q}, {_extract_sql(0.35)}, {_extract_sql(0.0, '2')} SELECT doc_id, question, round(u.score, 5) AS baseline, round(u2.score, 5) AS counterfactual, round(u2.score - u.score, 5) + 0.0 AS delta FROM u JOIN u2 USING (doc_id, question)")
def extractor_delta_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = documents.extractor_scores(_sentence_vectors(spark, sf_dir), _questions(spark, sf_dir))
    b = documents.extractor_scores(_sentence_vectors(spark, sf_dir), _questions(spark, sf_dir), threshold=0.0)
    got = documents.score_deltas(a, b)
    return got.select("doc_id", "question", *(rounded(F.col(c), 5).alias(c) for c in ("baseline", "counterfactual", "delta")))


LEXICON = (("the", 0.5), ("of", -0.25), ("worthless", -2.0), ("and", 0.125))


@query("""WITH l AS (SELECT * FROM (VALUES ('the', 0.5::DOUBLE), ('of', -0.25), ('worthless', -2.0), ('and', 0.125)) AS x(word, valence)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}'']+')) AS word FROM documents), s AS (SELECT doc_id, sum(coalesce(valence, 0)) AS s FROM w LEFT JOIN l USING (word) GROUP BY doc_id)
SELECT doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 6) + 0.0 AS compound FROM documents LEFT JOIN s USING (doc_id)""")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(LEXICON), "word string, valence double")
    return r6(documents.lexicon_compound(F.col("text"), lexicon, table(spark, sf_dir, "documents"), "doc_id"))


@query("""WITH x AS (SELECT doc_id, substr(text, 1, 200) AS t, quality = 1 AS truth FROM documents JOIN labels USING (doc_id)), h AS (SELECT *, ('0x' || substr(md5(t || '|poverty'), 1, 8))::BIGINT % 1000 / 1000.0::DOUBLE AS b FROM x)
SELECT doc_id, round(CASE WHEN truth THEN 0.55::DOUBLE + 0.35::DOUBLE * b ELSE 0.1::DOUBLE + 0.25::DOUBLE * b END, 6) AS score FROM h""")
def synthetic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", rounded(texts.synthetic_score(F.col("text"), F.lit("poverty"), F.col("quality") == 1)).alias("score"))


@query()
def ner_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a rule-based finder (capitalised words after a comma); needs Python, so no SQL."""
    return _texts(spark, sf_dir).select("id", F.md5(texts.ner_redaction(F.col("text"), capitals)).alias("text_md5"))


def capitals(text: str) -> list[tuple[int, int, str]]:
    import re

    return [(*m.span(1), "PERSON") for m in re.finditer(r", ([A-Z][a-z]+)", text)]
