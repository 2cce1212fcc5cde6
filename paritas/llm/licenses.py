"""License scans with ordered signature rules, in DataFrame expressions only.

A text is gated by a few word stems; only texts that have one are normalised (words in lower case, one blank between
them) and matched. The rules (``license_rules``: some 380 by hand) stand in passes. A pass runs where its keyword
occurs; its expression, one alternation that is compiled once, takes at each place the first rule that matches, and
marks the words. Detections are then word intervals; one that lies inside a detection of an earlier pass is suppressed:
one sweep over the intervals, sorted by start, keeps the last end of each pass. Everything is one projection over the
scan: no shuffle, no Python.

Defined results: a null text is an empty one (no words, no labels, score 0); repeated rows are each scanned; an empty
table gives an empty result; only the id and text columns are read. Two detections of one pass never overlap; of two
with the same words, that of the earlier pass stays. A text is scanned whole, in time linear in its length (the sweep
copies a byte for each detection before the one that it looks at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import pick
from paritas.llm.license_rules import PASSES, Pass

#: What is between words in the raw text, and in a text in lower case: one by one, as the regular expressions of the
#: JVM look single characters up in a table, but try ranges in turn.
RAW_GAP = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
GAP = RAW_GAP + "".join(f"\\x{c:02X}" for c in range(65, 91))

#: Every match of a rule holds one of these, or "cc" before one of ``CC``: a text without them has no detection.
GATES = (
    "licen", "copyright", "domain", "permission", "spdx", "copyleft", "warrant", "redistribut", "reserved", "gpl", "bsd", "cc0",
    "creative", "attribution", "apache", "cecill", "mulan", "wtfpl",
)
CC = ("by", "attribution", "zero", "licen")

#: The three phrases that count as base detections.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_SCORE = 0.8

#: Marks of the first and the last word of a detection; no normalised word has them.
_OPEN, _CLOSE = "\x01", "\x02"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{RAW_GAP}]++")).cast("long")


def lower(text: Column) -> Column:
    """In lower case; of the letters only A-Z become ASCII ones."""
    for other, instead in (("\u212a", "\u0138"), ("\u0130", "\u0131")):  # in lower case these two would be k and i
        text = F.replace(text, F.lit(other), F.lit(instead))
    return F.lower(text)


def gated(low: Column) -> Column:
    found = low.rlike(f"cc[{GAP}]+(?:{'|'.join(CC)})")
    for word in GATES:
        found = F.contains(low, F.lit(word)) | found
    return found


def normalised(low: Column) -> Column:
    """The words with a blank before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"[{GAP}]++", " ")), F.lit(" "))


def _marked(p: Pass) -> str:
    """``norm`` with marks around what the rules match; null without the keyword."""
    expression = f" ({p.before}(?:" + "|".join(f"(?:{e})" for _, e in p.rules) + "))(?= )"
    return f"CASE WHEN contains(norm, '{p.keyword}') THEN regexp_replace(norm, '{expression}', ' {_OPEN}$1{_CLOSE}') END"


def _detections(words: str, number: int, p: Pass) -> str:
    """Array of (start, back = -stop, pass, label, score) of one pass, from its marked words."""
    places = [f"filter(transform({words}, (w, i) -> CASE WHEN {f}(w, '{mark}') THEN i END), i -> i IS NOT NULL)" for f, mark in (("startswith", _OPEN), ("endswith", _CLOSE))]
    text = f"translate(array_join(slice({words}, a + 1, b - a + 1), ' '), '{_OPEN}{_CLOSE}', '')"
    cases = " ".join(f"WHEN t RLIKE '^{p.before}(?:{e})$' THEN '{label}'" for label, e in p.rules)
    label = f"element_at(transform(array({text}), t -> CASE {cases} END), 1)"
    return f"zip_with({places[0]}, {places[1]}, (a, b) -> named_struct('start', a, 'back', -b - 1, 'pass', {number}, 'label', {label}, 'score', {p.score}D))"


def _flags(in_order: Column) -> Column:
    """For each detection a character: 0 if it lies inside one of an earlier pass, else 1.

    Sorted by start, and of equal starts the longer and the earlier pass first: what contains a detection stands before
    it. ``ends`` has the furthest end of each pass so far.
    """
    start = F.struct(F.array_repeat(F.lit(-1), len(PASSES)).alias("ends"), F.lit("").alias("flags"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.exists(F.slice(acc["ends"], 1, d["pass"]), lambda end: end >= -d["back"])
        ends = F.transform(acc["ends"], lambda end, i: F.when(i == d["pass"], F.greatest(end, -d["back"])).otherwise(end))
        return F.struct(ends.alias("ends"), F.concat(acc["flags"], F.when(inside, "0").otherwise("1")).alias("flags"))

    return F.aggregate(in_order, start, step, lambda acc: acc["flags"])


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, ``base`` (at, label), ``kept`` (start, stop in words, pass, label, score), ``n_all``."""
    rows = pick(docs, id_col, text_col).select(F.col(id_col).alias("id_"), F.coalesce(text_col, F.lit("")).alias("t_"))
    rows = rows.select("id_", word_count(F.col("t_")).alias("n_words"), lower(F.col("t_")).alias("low"))
    rows = rows.select("id_", "n_words", F.when(gated(F.col("low")), normalised(F.col("low"))).alias("norm"))

    def base(word: Column, i: Column) -> Column:
        one, two = F.get(F.col("plain"), i - 1), F.get(F.col("plain"), i - 2)
        label = F.when(one == "mit", "mit").when(one == "apache", "apache").when((one == "public") & (two == "general"), "gpl")
        return F.when((word == "license") & label.isNotNull(), F.struct((i - F.when(label == "gpl", 2).otherwise(1)).cast("long").alias("at"), label.alias("label")))

    every = range(len(PASSES))
    rows = rows.select("id_", "n_words", "norm", F.when(F.col("norm").contains(" license "), F.split(F.trim("norm"), " ")).alias("plain"))
    # beside a lambda, as here, a projection is compiled by itself in small methods; as part of the whole stage its one
    # method would be too large for the JVM to compile further, and twice as slow
    rows = rows.select("id_", "n_words", F.filter(F.transform("plain", base), lambda x: x.isNotNull()).alias("base"), *(F.expr(_marked(p)).alias(f"m{k}") for k, p in enumerate(PASSES)))
    rows = rows.select("id_", "n_words", "base", *(F.when(F.col(f"m{k}").contains(_OPEN), F.split(F.trim(f"m{k}"), " ")).alias(f"w{k}") for k in every))
    found = F.expr("flatten(filter(array(" + ", ".join(_detections(f"w{k}", k, p) for k, p in enumerate(PASSES)) + "), d -> d IS NOT NULL))")
    rows = rows.select(
        "id_", "n_words", "base", F.when(F.coalesce(*(F.col(f"w{k}") for k in every)).isNotNull(), F.array_sort(found)).alias("found"),
    )
    # zipped, not looked up in a lambda: there Catalyst would sweep anew for each detection
    both = F.arrays_zip(F.col("found").alias("d"), F.split(_flags(F.col("found")), "").alias("f"))
    kept = F.transform(F.filter(both, lambda x: (x["f"] == "1") & x["d"].isNotNull()), lambda x: x["d"])
    kept = F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("stop"), d["pass"].alias("pass"), d["label"].alias("label"), d["score"].alias("score")))
    return rows.select(F.col("id_").alias(id_col), "n_words", "base", kept.alias("kept"), F.size("found").alias("n_all"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections, n_suppressed."""
    none = F.array().cast("array<string>")
    labels = lambda c: F.coalesce(F.transform(c, lambda x: x["label"]), none)
    at = F.transform("base", lambda x: x["at"])
    n_kept = F.when(F.col("kept").isNotNull(), F.size("kept")).otherwise(0)
    return detections(docs, id_col, text_col).select(
        id_col, "n_words", F.when(F.col("base").isNotNull(), F.size("base")).otherwise(0).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels("base"), labels("kept")))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
        n_kept.cast("long").alias("n_detections"), (F.when(F.col("kept").isNotNull(), F.col("n_all")).otherwise(0) - n_kept).cast("long").alias("n_suppressed"),
    )
