"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns: no operator breaks, and each case has its result."""

import public_tokenizers
import pytest

import corpus_pipeline
from paritas.llm import byte_bpe, decontaminate, licenses, line_dedup, ppm, quality, simhash, token_files, toxicity, warc

LONG = "The quick brown fox jumps over a lazy dog number " * 3000
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "   \n\n \t"), (None, "no id"), (5, LONG), (6, LONG + "end"), (7, "x" * 50_000), (None, None), (8, "ça \x00 İ ſ\n#*$")]
BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if i is None else "en", "s", 1) for i, t in rows], SCHEMA)


def clashing(df):
    """Columns named like what operators use inside, among them like inputs but for the case."""
    from pyspark.sql import functions as F

    for name in ("kept", "fp", "ids", "file", "n_words", "words", "norm", "doc", "line", "m_", "c0", "least", "shard", "start", "html_", "Text_", "DOC"):
        if name.lower() not in {c.lower() for c in df.columns}:
            df = df.withColumn(name, F.lit("x"))
    return df


def operators(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "ça")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 1), (None, 1, 0), (3, None, 1), (6, 0, 0)], "doc_id long, toxic int, quality int")
    return {
        "quality": lambda d: quality.apply_policy(quality.ledger(d)),
        "contamination": lambda d: decontaminate.contamination(d, items),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "licenses": licenses.scan,
        "lines": line_dedup.line_report,
        "bpe": lambda d: byte_bpe.round_trip(d, *BPE),
        "languages": lambda d: ppm.identify(d, ppm.fit(d)),
        "simhash": simhash.near_duplicates,
        "tokens": lambda d: token_files.document_index(spark, token_files.write(d, WORDS, partitions=2)),
    }


NAMES = ["quality", "contamination", "toxicity", "licenses", "lines", "bpe", "languages", "simhash", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, name):
    rows = operators(spark)[name](frame(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, name):
    op = operators(spark)[name]
    assert sorted(map(str, op(clashing(frame(spark))).collect())) == sorted(map(str, op(frame(spark)).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    got = operators(spark)[name](frame(spark, []))
    assert got.count() == 0 and got.columns == operators(spark)[name](frame(spark)).columns


def test_pages(spark):
    schema = "page_id long, url string, html string, sha1 string, first string"
    rows = [(1, None, None, "x", "x"), (None, "u", "a", "x", "x"), (2, "u", "a", "x", "x"), (2, "u", "a", "x", "x"), (3, "u", LONG, "x", "x")]
    got = sorted(map(str, warc.read(warc.write(spark.createDataFrame(rows, schema))).collect()))
    assert len(got) == 5 and sum("revisit" in g for g in got) == 1
    assert warc.read(warc.write(spark.createDataFrame([], schema))).count() == 0


def test_defined_results(spark):
    ops, d = operators(spark), frame(spark)
    lang = {r["doc_id"]: r["lang_pred"] for r in ops["languages"](d).collect()}
    assert lang[2] == lang[3] == lang[4] == "und" and lang[1] == "en"
    sim = {r["doc_id"]: (r["fp"], r["component_id"]) for r in ops["simhash"](d).collect() if r["doc_id"]}
    assert sim[2] == sim[3] == sim[4] == (0, 2)
    tokens = {r["doc_id"]: r["n_tokens"] for r in ops["tokens"](d).collect() if r["doc_id"]}
    assert tokens[2] == tokens[3] == tokens[4] == 1
    nothing = toxicity.score(d, toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int, quality int"))).collect()
    assert not any(r["toxic"] or r["p_toxic"] for r in nothing)


def prose(seed, n=80):
    import numpy as np

    rng = np.random.default_rng(seed)
    return ".\n".join(" ".join(f"word{x}" for x in rng.integers(0, 4000, 10)) for _ in range(n // 10))


def test_pipeline_stages(spark, tmp_path):
    """Junk goes, lines and documents that repeat go, benchmark passages are cut, clean documents stay as they are."""
    passage = " ".join(f"item{i}" for i in range(20))
    clean = {i: prose(i) for i in range(10)}
    near = prose(3).split("\n")
    rows = [*clean.items(), (20, "too short"), (21, "spam spam spam " * 40), (22, prose(2)), (23, "\n".join(w.replace("word1", "wordx1").replace("word2", "wordy2") for w in near[:2]) + "\n" + "\n".join(near[2:])), (24, prose(24) + "\n" + passage + " tail")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert {20, 21} & set(kept["quality rules"]) == set() and set(range(10)) <= set(kept["quality rules"])
    assert 22 not in kept["line dedup"] and set(range(10)) <= set(kept["benchmark decontamination"])
    last = kept["benchmark decontamination"]
    assert all(last[i]["text"] == t for i, t in clean.items())
    assert "item3" not in last[24]["text"] and last[24]["text"].endswith(" tail") and last[24]["n_chars"] == len(last[24]["text"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    import hashlib

    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in last.items()}


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (frame(spark, []), frame(spark), clashing(frame(spark))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
            stage(spark, docs, str(tmp_path)).count()
