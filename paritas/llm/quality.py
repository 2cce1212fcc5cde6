"""Quality rules: a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each failed
rule; policies (a version, a set of rules) are applied afterwards as bitwise tests, and ablations are sums
over the distinct bit patterns. Texts are read in one scan without a shuffle; the only shuffle in ablations
is of bit patterns, pre-aggregated on the map side.

Defined results: a null or empty text has no words and all counts are 0 (it fails ``few_words``); null ids
pass through; repeated rows are each judged alone; an empty table gives an empty ledger. Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from paritas.llm.common import pick, small_batches, worker_state

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "max_word", "n_marks")
_TYPE = StructType([StructField(m, LongType()) for m in MEASURES])


def repeat_words(words: list, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + size - max(i, upto)
            upto = i + size
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            dups += line in seen
            seen.add(line)
    letters = sum(map(str.isalpha, text))
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), lines, dups, repeat_words(words),
        letters, sum(map(str.isupper, text)) if letters else 0, max(map(len, words), default=0), text.count("!") + text.count("?"),
    )


@arrow_udf(_TYPE)
def measured(texts: pa.Array) -> pa.Array:
    worker_state("quality")
    rows = [measure(t.as_py()) for t in texts]
    columns = list(zip(*rows)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


@dataclass(frozen=True)
class Rule:
    """``failed``: from a getter of measurements to a boolean column that is true where the rule fails."""

    name: str
    failed: object


#: Order gives the bit. A rule is never moved or reused: ledgers written earlier keep their meaning.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 5 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("upper_case", lambda m: 2 * m("n_upper") > m("n_letters")),
    Rule("few_letters", lambda m: 2 * m("n_letters") < m("word_chars")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    Rule("marks", lambda m: m("n_marks") > m("n_words")),
    Rule("one_huge_word", lambda m: m("max_word") > 1000),
)
BIT = {rule.name: i for i, rule in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "upper_case", "few_letters", "short_words", "long_words", "marks"),
}
DEFAULT_POLICY = "v2"


def mask(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def fail_bits(get) -> Column:
    """One long with a bit for each failed rule."""
    return F.lit(0).cast("long") if not RULES else sum((F.when(r.failed(get), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``. One scan, no shuffle."""
    rows = pick(docs, id_col, text_col).select(F.col(id_col), measured(F.col(text_col)).alias("m_"))
    rows = rows.select(id_col, *(F.col(f"m_.{m}").alias(m) for m in MEASURES))
    return rows.withColumn("fail_bits", fail_bits(F.col))


def apply_policy(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed``, ``policy`` and ``kept``; texts are not read again."""
    base = F.lit(mask("v1"))
    return entries.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(base) != 0,
        "policy": F.lit(policy),
        "kept": F.col("fail_bits").bitwiseAND(base.bitwiseOR(F.lit(mask(policy)))) == 0,
    })


def ablations(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    Documents are summed by bit pattern first (at most 2**rules rows), so only patterns are shuffled.
    """
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    ones = [F.struct(F.lit(name).alias("rule"), F.lit(1 << BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]]
    long = patterns.select("bits", "n", F.explode(F.array(*ones)).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return long.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_fail_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_clean(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; one scan, no shuffle and no join."""
    small_batches(docs.sparkSession)
    names = list(docs.columns)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index(text_col)
    inner = inner.withColumn("m", measured(F.col(f"c{at}")))
    bits = fail_bits(lambda m: F.col(f"m.{m}"))
    return inner.where(bits.bitwiseAND(F.lit(mask("v1") | mask(policy))) == 0).drop("m").toDF(*names)
