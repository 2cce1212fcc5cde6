"""Corpora, scores and configurations from files, and reports to files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = (
    "applicant_id string, seed_key string, stratum struct<race: string, gender: string, school_tier: string>, instance int, "
    "text string, expected_question_truth map<string, boolean>"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One record a line, blank lines skipped, strata as columns. The schema is given, so the file is read once."""
    rows = spark.read.schema(CORPUS).json(path).where(F.col("applicant_id").isNotNull())
    return rows.select(
        "applicant_id", "seed_key", *(F.col(f"stratum.{x}").alias(f"stratum_{x}") for x in ("race", "gender", "school_tier")), "instance", "text",
        F.col("expected_question_truth").alias("expected_truth"), F.concat_ws("|", "stratum.race", "stratum.gender", "stratum.school_tier").alias("stratum_key"),
    )


def write_corpus(df: DataFrame, path: str) -> int:
    """Records as JSON lines; returns how many."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def read_scores(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Scores with a header; without a schema it is inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_scores(df: DataFrame, path: str, private: Sequence[str] = ("text", "text_stripped", "expected_truth")) -> None:
    """Scores without the texts they were made from."""
    df.drop(*private).write.mode("overwrite").option("header", True).csv(path)


def export_predictions(df: DataFrame, path: str, proba: str = "proba", yhat: str = "yhat") -> DataFrame:
    """Writes the rows with ``score`` and ``invited``, and returns them."""
    out = df.withColumn("score", F.col(proba)).withColumn("invited", F.col(yhat)).drop(*({proba, yhat} - {"score", "invited"}))
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _driver_text(spark: SparkSession, path: str) -> str:
    """A small configuration file, by Spark's reader, so that any store will do."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_anchorings(spark: SparkSession, path: str, bare_list: bool = False) -> DataFrame:
    """Rows (label, low, high) of a JSON file with the key ``anchorings``, or a list if allowed."""
    got = json.loads(_driver_text(spark, path))
    if isinstance(got, list):
        if not bare_list:
            raise ValueError("expected an object with the key 'anchorings'")
    else:
        got = got["anchorings"]
    return spark.createDataFrame([(x["label"], float(x["low_sentiment"]), float(x["high_sentiment"])) for x in got], "label string, low double, high double")


def read_dilution_config(spark: SparkSession, path: str) -> dict:
    """Instruments, skeleton, variants and pairs; parts given as {file: name} are read beside the configuration."""
    got = json.loads(_driver_text(spark, path))
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    text = lambda x: _driver_text(spark, f"{folder}/{x['file']}") if isinstance(x, dict) else x
    return {"instruments": got.get("instruments", ["vader"]), "skeleton": text(got["skeleton"]), "variants": {k: text(v) for k, v in got["variants"].items()}, "pairs": [tuple(p) for p in got["pairs"]]}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables as one JSON document on the driver; missing values are nulls."""

    def plain(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x

    Path(path).write_text(json.dumps({name: [plain(r.asDict(recursive=True)) for r in df.collect()] for name, df in tables.items()}, indent=2))


def call_model(df: DataFrame, text: str, ask: Callable[[str], str], key: str, retries: int = 3, to: str = "content") -> DataFrame:
    """Answers of an external model, row by row within a partition. ``ask``: from a prompt to an answer; built lazily on executors.

    Errors that say a parameter is "not supported" are retried with ``ask.plain`` if it has one.
    """
    import pyarrow as pa

    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prompt in batch.column(1).to_pylist():
                call = ask
                for i in range(retries):
                    try:
                        out.append(call(prompt or ""))
                        break
                    except Exception as e:
                        call = getattr(ask, "plain", ask) if "not supported" in str(e) else call
                        if i + 1 == retries:
                            raise
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, to])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {to} string")


def load_scorer(spec: str) -> Callable:
    """``module:function``: from a list of texts to an array of scores."""
    import importlib

    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"expected module:function, not {spec!r}")
    return getattr(importlib.import_module(module), name)


def score_column(scorer: Callable):
    """A column function of a list scorer, on Arrow batches."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import DoubleType

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.asarray(scorer([t or "" for t in texts.to_pylist()]), dtype=float))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, DoubleType())
