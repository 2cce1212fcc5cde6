"""Text rules, sections, parsing, embeddings, sources and the stream monitor."""

import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.functions import texts
from paritas.operators import documents
from paritas.plans import audits
from paritas.sources import corpora
from paritas.streaming.monitor import windowed_impact


def apply(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize("text,out", [
    ("Mr. Smith", "[HONORIFIC]. Smith"), ("HER and Hers", "their and theirs"), ("éher", "éher"), ("miss it", "[HONORIFIC] it"),
    ("black coffee", "[ETHNICITY] coffee"), ("at harvard", "at [SCHOOL]"), ("Foo Medical College", "[SCHOOL]"), ("", ""), (None, ""),
])
def test_anonymise(spark, text, out):
    assert apply(spark, texts.anonymise, text) == [out]


def test_custom_pattern_with_back_reference(spark):
    assert apply(spark, lambda t: texts.anonymise(t, custom=[(r"id (\d+)", r"<\1> $")]), "ID 77") == ["<77> $"]


def test_rules_agree_with_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", texts.apply_rules(F.col("text"), texts.PRONOUNS).alias("t")).collect()
    for r in rows:
        want = r["text"]
        for p, x in texts.PRONOUNS:
            want = re.sub(p, x, want, flags=re.IGNORECASE)
        assert r["t"] == want


def test_substitution_upserts(spark):
    assert apply(spark, lambda t: texts.substitute(t, [(r"\bwarm\b", "cool"), (r"\bnew\b", "old")]), "Warm new CARING") == ["cool old skilled"]
    assert apply(spark, lambda t: texts.substitute(t, ignore_case=False), "Warm warm") == ["Warm professional"]


def test_sentences_and_words(spark):
    long = "This is a sentence of words.  Too short. And\nanother one that counts! ok"
    assert apply(spark, texts.sentences, long) == [["This is a sentence of words.", "And another one that counts!"]]
    assert apply(spark, texts.sentences, None) == [[]]
    assert apply(spark, texts.word_count, " a b  c ", "", None) == [3, 0, 0]


def test_template_without_its_mark(spark):
    assert apply(spark, lambda t: texts.fill_template(F.lit("a {VARIANT_PARAGRAPH} b"), t), "x") == ["a x b"]
    with pytest.raises(Exception, match="is missing"):
        apply(spark, lambda t: texts.fill_template(F.lit("nothing"), t), "x")


def test_sections(spark):
    text = "intro\nFIRST PART\nbody one\nmore\nEMPTY HEAD\nNEXT HEAD\n-----\n12345\n\nlast\nABC"
    got = documents.sections(spark.createDataFrame([(1, text), (2, ""), (3, "HEADER ONLY")], "d int, t string"), "d", "t").orderBy("d", "pos").collect()
    assert [(r["d"], r["pos"], r["label"], r["body"]) for r in got] == [(1, 1, "PREAMBLE", "intro"), (1, 2, "FIRST PART", "body one\nmore"), (1, 3, "NEXT HEAD", "-----\n12345\n\nlast\nABC")]
    own = documents.sections(spark.createDataFrame([(1, "# a\nx\n# b\ny")], "d int, t string"), "d", "t", "# ").orderBy("pos").collect()
    assert [r["label"] for r in own] == ["# a", "# b"]


def test_lowest_section_and_unanimity(spark):
    rows = [(1, 1, "A", "x", 0.5), (1, 2, "B", "x", 0.1), (1, 1, "A", "y", 0.9), (1, 2, "B", "y", 0.9), (2, 1, "A", "x", 0.0)]
    got = {(r["d"], r["instrument"]): (r["lowest"], r["unanimous"]) for r in documents.rank_lowest(spark.createDataFrame(rows, "d int, pos int, label string, instrument string, score double"), "d", 2).collect()}
    assert got == {(1, "x"): ("B", False), (1, "y"): ("A", False), (2, "x"): ("A", False)}


def test_paragraph_audit(spark):
    df = spark.createDataFrame([("d", "FIRST PART\n" + "word " * 60 + "\nSECOND PART\nfew words")], "k string, t string")
    rows, low = audits.paragraph_audit(df, "k", "t", {"n": lambda t: F.length(t).cast("double"), "m": lambda t: F.lit(1.0)})
    assert [(r["label"], r["scored"]) for r in rows.orderBy("pos").collect()] == [("FIRST PART", True), ("SECOND PART", False)]
    assert all(r["unanimous"] and r["lowest"] == "FIRST PART" for r in low.collect())


def test_extractor_without_active_sentences(spark):
    s = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.1, 0.1])], "doc_id int, sent_no int, vec array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "question string, vec array<double>")
    got = {r["question"]: r["score"] for r in documents.extractor_scores(s, q).collect()}
    assert got["a"] == pytest.approx(1, abs=0.01) and got["_total"] == pytest.approx(got["a"] + got["b"])
    assert {r["score"] for r in documents.extractor_scores(s.where("sent_no = 2"), q).collect()} == {0.0}


def test_means_without_pairs_equal_means_of_pairs(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").alias("seed"), (F.col("vec_id") % 3).alias("stratum"), F.col("embedding").alias("vec"))
    a = {r["level"]: (r["n"], r["mean"]) for r in documents.distance_means(e, "vec_id", "seed", "stratum").collect()}
    b = {r["level"]: (r["n"], r["mean"]) for r in documents.summarise(documents.pair_distances(e, "vec_id", "seed", "stratum"), "distance", ["level"]).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-6) for k in a)


def levels_by_pairs(rows):
    """Level to n, mean, median, tenth and ninetieth percentile, from a list of all pairs; rows (id, seed, stratum, vec)."""
    found = {}
    for a, b in itertools.combinations(rows, 2):
        level = 2 if a[1] != b[1] else int(a[2] != b[2])
        found.setdefault(documents.LEVELS[level], []).append(1 - float(np.dot(a[3], b[3])))
    return {k: (len(d), np.mean(d), *np.quantile(d, [0.5, 0.1, 0.9])) for k, d in found.items()}


@pytest.mark.parametrize("n,copies,kind", [(150, 0, "float"), (150, 60, "double"), (300, 300, "float"), (2, 0, "double")])
def test_distance_levels_equal_a_list_of_all_pairs(spark, monkeypatch, n, copies, kind):
    monkeypatch.setattr(documents, "BLOCK_ROWS", 16)
    monkeypatch.setattr(documents, "STRIPE", 50)
    monkeypatch.setattr(documents, "pair_distances", None)
    draw = np.random.default_rng(n + copies)
    vectors = draw.normal(size=(n, 5)).astype(np.float32).astype(float)
    vectors[:copies] = vectors[0]
    rows = [(i, f"s{i % 7 % 3}", i % 2, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"id int, seed string, stratum int, vec array<{kind}>")
    got = {r["level"]: (r["n"], r["mean"], r["median"], r["p10"], r["p90"]) for r in audits.content_equivalence(df, "id", "seed", "stratum")[0].collect()}
    want = levels_by_pairs(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_distance_levels_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", 1, [1.0, 0.0]), (2, "a", 1, None)], "id int, seed string, stratum int, vec array<double>")
    assert documents.distance_levels(df.where("id = 1"), "id", "seed", "stratum").count() == 0
    assert documents.distance_levels(df.where("id = 0"), "id", "seed", "stratum").count() == 0
    with pytest.raises(ValueError, match="missing"):
        documents.distance_levels(df, "id", "seed", "stratum")


def test_dilution(spark):
    excerpts = spark.createDataFrame([("low", "aa"), ("high", "aaaa")], "variant string, text string")
    pairs = spark.createDataFrame([("low", "high"), ("low", "none")], "low string, high string")
    got = audits.dilution(excerpts, "x{VARIANT_PARAGRAPH}y", pairs, {"n": lambda t: F.length(t).cast("double"), "c": lambda t: F.lit(1.0)}).orderBy("instrument").collect()
    assert [(r["instrument"], r["pair"], r["excerpt_gap"], r["dilution_ratio"]) for r in got] == [("c", "high − low", 0.0, None), ("n", "high − low", 2.0, 1.0)]


def test_corpus_round_trip(spark, tmp_path):
    rows = [{"applicant_id": "PS0001", "seed_key": "s", "instance": 1, "stratum": {"race": "Asian", "gender": "Male", "school_tier": "top_20"}, "expected_question_truth": {"poverty": True}, "text": "x"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = corpora.read_corpus(spark, str(tmp_path / "c.jsonl"))
    row = got.first()
    assert got.count() == 1 and row["stratum_key"] == "Asian|Male|top_20" and row["expected_truth"] == {"poverty": True}
    assert corpora.write_corpus(got, str(tmp_path / "out")) == 1
    corpora.write_scores(got.withColumn("score", F.lit(1.0)).drop("expected_truth"), str(tmp_path / "scores"))
    assert "text" not in corpora.read_scores(spark, str(tmp_path / "scores")).columns


def test_configurations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"anchorings": [{"label": "x", "low_sentiment": 0.1, "high_sentiment": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps([]))
    (tmp_path / "sk.txt").write_text("{VARIANT_PARAGRAPH}")
    (tmp_path / "d.json").write_text(json.dumps({"skeleton": {"file": "sk.txt"}, "variants": {"v": "t"}, "pairs": [["v", "v"]]}))
    assert corpora.read_anchorings(spark, str(tmp_path / "a.json")).first()["high"] == 1.0
    with pytest.raises(ValueError):
        corpora.read_anchorings(spark, str(tmp_path / "b.json"))
    got = corpora.read_dilution_config(spark, str(tmp_path / "d.json"))
    assert got["skeleton"] == "{VARIANT_PARAGRAPH}" and got["instruments"] == ["vader"]


def test_report_has_no_nan(spark, tmp_path):
    corpora.write_report({"t": spark.createDataFrame([(float("nan"), None, 1.5)], "a double, b double, c double")}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"t": [{"a": None, "b": None, "c": 1.5}]}


def test_aligned_wants_partners(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert [tuple(r) for r in documents.aligned(a.where("k = 1"), b, "k").collect()] == [(1, "x", "z")]
    with pytest.raises(Exception, match="no partner for 2"):
        documents.aligned(a, b, "k").collect()


def test_unmatched_scores_stay(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0.5)], "k int, s double")
    rows, counts = documents.join_scores(a, b, "k")
    assert sorted(map(tuple, rows.collect())) == [(1, 0.5), (2, None)] and counts.first()["unmatched"] == 1


def test_confirmatory(spark):
    rows = [(f"PS{i}", ("top_20", "mid_tier", "lower_tier")[i % 3], f"He studied at Harvard medical school {'x' * (i % 5)}") for i in range(30)]
    df = spark.createDataFrame(rows, "applicant_id string, stratum_school_tier string, text string")
    got = audits.confirmatory_test(df, lambda t: F.length(t).cast("double")).first()
    assert got["n0"] == 20 and got["n1"] == 10 and got["k"] == 9 and got["decision"] in ("H0", "H1", "ambiguous", "undefined")
    assert apply(spark, lambda t: texts.tier_substitution(t, F.lit("top_20")), rows[0][2]) == ["He studied at [TIER1_SCHOOL] medical school "]


def test_word_shares(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    rows = spark.createDataFrame([(1, "Good bad thing"), (2, ""), (3, None)], "k int, t string")
    got = {r["k"]: (r["neg"], r["neu"], r["pos"]) for r in documents.lexicon_scores(F.col("t"), lexicon, rows, "k").collect()}
    assert got[1] == pytest.approx((2 / 6, 1 / 6, 3 / 6)) and got[2] == got[3] == (0.0, 1.0, 0.0)


def test_model_calls_and_scorers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert {r["id"]: r["content"] for r in corpora.call_model(df, "t", str.upper, "id").collect()} == {1: "A", 2: ""}
    scorer = corpora.load_scorer("test_texts:lengths")
    assert [r[0] for r in df.select(corpora.score_column(scorer)("t")).collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        corpora.load_scorer("nothing")


def lengths(values):
    return [float(len(v)) for v in values]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    group, chosen = F.when(F.col("user_id") % 2 == 0, 0).otherwise(1), F.col("value") > 50
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_impact(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", group, chosen, "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("impact").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("impact").collect())) == sorted(map(tuple, windowed_impact(events, "ts", group, chosen, "1 day").collect()))


def by_tier(text, tier):
    """Phrases of capitals before a kind of school; then short names with a word of the context near them."""
    import re

    mark = f"[{texts.TIERS[tier]}_SCHOOL]"
    text = re.sub(texts.TIER_PHRASE, mark, text, flags=re.A)
    cues = [m.span() for m in re.finditer(texts.TIER_CUES, text, flags=re.A)]
    out, at = [], 0
    for m in re.finditer(r"\b(?:" + "|".join(sorted(texts.TIER_NAMES, key=len, reverse=True)) + r")\b", text, flags=re.A):
        near = any(0 <= a - m.end() <= texts.TIER_WINDOW or 0 <= m.end() - b <= texts.TIER_WINDOW + 24 for a, b in cues)
        out += [text[at : m.start()], mark if near else m.group()]
        at = m.end()
    return "".join([*out, text[at:]])


def test_tier_query_by_brute_force(spark, sf):
    import hashlib

    from paritas.queries import texts as text_queries

    want = {r["id"]: None if r["text"] is None else by_tier(r["text"], r["tier"]) for r in text_queries.tiered(spark, sf).collect()}
    got = {r["id"]: r for r in text_queries.tier_school_substitution(spark, sf).collect()}
    assert len(want) > 100 and sum("_SCHOOL]" in (t or "") for t in want.values()) > 50
    for i, text in want.items():
        assert got[i]["text_md5"] == hashlib.md5((text or "").encode()).hexdigest(), i
    literal = {-3: "She studied at [TIER3_SCHOOL], then [TIER3_SCHOOL] and lower-case yale hospital.", -7: "Iowa is flat. Nothing else here.", -8: "He trained as a physician near [TIER2_SCHOOL] and at [TIER2_SCHOOL]."}
    assert {i: want[i] for i in literal} == literal


LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "kind": 2.4}


def compound(total):
    return total / (total * total + 15) ** 0.5


@pytest.mark.parametrize(
    "text,total",
    [
        ("it was good", 1.9), ("it was not good", 1.9 * -0.74), ("it was very good", 1.9 + 0.293), ("it was slightly good", 1.9 - 0.293), ("it wasn't a good day", 1.9 * -0.74),
        ("it was GOOD", 1.9 + 0.733), ("GOOD", 1.9), ("it was good!!", 1.9 + 2 * 0.292), ("bad!!!!!!", -2.5 - 4 * 0.292), ("really, a good day", 1.9 + 0.293 * 0.95), ("good but horrible", 1.9 * 0.5 - 2.5 * 1.5),
        ("nothing of value", 0.0), ("good?? kind", 4.3 + 0.36), ("so far from what was kind", 2.4),
    ],
)
def test_tone_rules(text, total):
    from paritas.functions import sentiment

    neg, neu, pos, got = sentiment.tone(text, LEXICON)
    assert got == pytest.approx(compound(total)) and neg + neu + pos == pytest.approx(1)


def test_tone_of_nothing(spark):
    from paritas.functions import sentiment

    assert sentiment.tone("", LEXICON) == sentiment.tone(None, LEXICON) == (0.0, 1.0, 0.0, 0.0)
    got = apply(spark, lambda t: sentiment.lexicon_tone(LEXICON)(t)["compound"], "it was good", None)
    assert got == [pytest.approx(compound(1.9)), 0.0]


def test_instruments_by_name(spark):
    from paritas.plans.instruments import instruments

    with pytest.raises(ValueError, match="nosuch"):
        instruments(["lexicon", "nosuch"], lexicon=LEXICON)
    some = instruments(["llm", "lexicon", "transformer"], lexicon=LEXICON, ask=lambda t: F.concat(F.lit('{"compound": 0.5, "rationale": "'), t, F.lit('"}')), transformer=lambda t: F.length(t) * 1.0)
    assert list(some) == ["llm", "lexicon", "transformer"]
    document = "FIRST PART\nit was good\nSECOND PART\nit was a bad and horrible day\n"
    rows, lowest = audits.paragraph_audit(spark.createDataFrame([("a", document)], "id string, text string"), "id", "text", some, 2)
    got = {r["label"]: (r["llm"], round(r["lexicon"], 4), r["transformer"]) for r in rows.collect()}
    assert got == {"FIRST PART": (0.5, round(compound(1.9), 4), 1.0), "SECOND PART": (0.5, round(compound(-5.0), 4), 1.0)}
    assert {r["instrument"]: r["lowest"] for r in lowest.collect()}["lexicon"] == "SECOND PART"


def test_default_ids(spark):
    rows = spark.range(500).select((500 - F.col("id")).alias("line"), F.lit("x").alias("text")).repartition(7)
    got = {r["line"]: r["applicant_id"] for r in documents.numbered(rows, "line").collect()}
    assert got == {i: f"A{i:04d}" for i in range(1, 501)}


def test_bootstrap_metrics_and_model_bars(spark):
    from paritas.plans import simulations

    def replicate(seed):
        return {"a": float(seed), "b": 1.0} if seed % 2 else {"a": float(seed)}

    got = {r["metric"]: tuple(r)[1:] for r in simulations.bootstrap_metrics(spark, replicate, 5, 10).collect()}
    assert got["a"][:2] == (12.0, 12.0) and got["a"][4] == 5 and got["b"][4] == 2
    only = {r["metric"]: r["n_reps"] for r in simulations.bootstrap_metrics(spark, replicate, 5, 10, ["b", "c"]).collect()}
    assert only == {"b": 2, "c": 0}
    stages = spark.createDataFrame([("m", "x", s, k, p, p - 0.1, p + 0.1) for s, p in (("baseline", 0.7), ("counterfactual", 0.9)) for k in ("disparate_impact", "selection_rate_group0")], "model string, anchoring string, stage string, metric string, point double, ci_lo double, ci_hi double")
    assert sorted((r["model"], r["stage"], r["passes"]) for r in simulations.model_bars(stages).collect()) == [("m", "baseline", False), ("m", "counterfactual", True)]
