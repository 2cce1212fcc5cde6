"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared as sequences of words (A-Z in lower case). Two lines are duplicates if their edit distance in
words is at most one (one word changed, added or left out); a line goes if an earlier one, by (document, place), is
its duplicate. Equal lines are merged first. Each remaining line emits, as hashed keys, itself and itself without
one word, for all words; lines with an equal variant are joined. A group of lines with an equal variant is never
expanded into pairs: with the same word left out all of them are within one substitution of each other, so each is
linked to the earliest; a line that equals the variant is one insertion from each of them. Every link is then
verified by the edit distance of the two lines.

Before variants are made, a line must share its first or its second half with another line (if two lines are one
edit apart, one half is untouched); only words of the other half can be the edit, so only those are left out. This
is exact. Every shuffle is of hashes with a map-side combine, but for the texts of lines with a partner; joins on a
line or a variant that many others share are dealt to many tasks (``join_hot``).

Defined results: lines without a word stay and are never compared; null and empty texts have no lines and stay;
of equal places (rows that repeat an id) the lines are one line, and both rows keep it; null ids stay whole and are
not compared; a document whose lines with words all go is dropped by ``drop_duplicates``. A line of one word is a
duplicate only of an equal line: without its word it is empty, and one edit from any other such line. ``min_words``
can raise that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import join_hot, materialise, maybe_in, pick, word_bytes, worker_state

#: Fewest words of a line that has variants: without one word, another is left.
MIN_WORDS = 2
_LINE = "doc long, line int"
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def halves(words: list[bytes], min_words: int = MIN_WORDS) -> list[int | None]:
    """Keys of a line's halves: (first, second) as the shorter and as the longer line of a pair, where there can be one."""
    n, out = len(words), []
    for s in (n, n - 1):  # the number of words of the shorter line
        if s < min_words:
            out += [None, None]
            continue
        a = s // 2
        for tag, part in ((b"f%d " % s, words[:a]), (b"s%d " % s, words[len(words) - (s - a) :])):
            out.append(xxhash.xxh64_intdigest(tag + b" ".join(part)) - (1 << 63))
    return out


def variant_keys(words: list[bytes], first: bool, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line without word i, and i, for the words outside a half that has a partner.

    ``first``, ``second``: whether the first or the second half is shared. A polynomial over word hashes gives each
    variant in constant time from the sums before and after the word.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.cumprod(np.full(n, _MULTIPLIER, np.uint64))
        terms = h * power[:n]
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        # after the word, each place moves down by one: sum of h[j] * power[j - 1]
        moved = np.concatenate((np.zeros(1, np.uint64), h[1:] * power[: n - 1]))
        after = np.cumsum(moved[::-1])[::-1]
        after = np.concatenate((after[1:], np.zeros(1, np.uint64)))
        keys = before[:n] + after
    a, b = max(0, (n - 1) // 2 - 1), min(n, n // 2 + 1)  # halves of lines of n and n - 1 words, with both borders
    low, high = (0 if second else a), (n if first else b)
    at = np.arange(low, high)
    return _mix(keys[low:high]), at


def full_key(words: list[bytes]) -> int:
    with np.errstate(over="ignore"):
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        power = np.ones(len(words), np.uint64)
        power[1:] = np.cumprod(np.full(len(words) - 1, _MULTIPLIER, np.uint64))
        return int(_mix(np.array([(h * power).sum(dtype=np.uint64)], np.uint64))[0])


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of sums; as signed longs."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance in words is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def place(doc: Column, line: Column) -> Column:
    return F.struct(doc.alias("doc"), line.alias("line"))


def _scan(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """A row per line with words: 128-bit hash, place, words, keys of halves (null for short lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("line_dedup.scan")
        names = ["h1", "h2", "doc", "line", "n", "k0", "k1", "k2", "k3"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                for doc, text in zip(batch.column(0).slice(at, 500).to_pylist(), batch.column(1).slice(at, 500)):
                    for i, line in enumerate(text.as_py().split("\n")):
                        words = word_bytes(line)
                        if not words:
                            continue
                        h = xxhash.xxh3_128_intdigest(b" ".join(words))
                        out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc, i, len(words), *halves(words, min_words)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("line", "n") else pa.int64()) for n, c in zip(names, zip(*out))], names=names)

    rows = pick(docs, id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(run, f"h1 long, h2 long, {_LINE}, n int, k0 long, k1 long, k2 long, k3 long")


def _distinct(lines: DataFrame) -> DataFrame:
    """The earliest place of each distinct line. Fixed-width columns only: partial sums stay in memory."""
    packed = (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line")).cast("decimal(38,0)")
    got = lines.groupBy("h1", "h2").agg(F.min(packed).alias("p"), F.count("*").alias("copies"), F.max("n").alias("n"), *(F.max(f"k{i}").alias(f"k{i}") for i in range(4)))
    line = F.pmod(F.col("p"), F.lit(1 << 31).cast("decimal(11,0)"))
    doc = ((F.col("p") - line) / F.lit(1 << 31).cast("decimal(11,0)")).cast("long")
    return got.select(doc.alias("doc"), line.cast("int").alias("line"), "n", "copies", "k0", "k1", "k2", "k3")


def _candidates(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts of the wanted lines: (doc, line, first, second, text).

    Only documents with a wanted line are shuffled, and few others: a bit table of fixed size, broadcast, tells most
    of the others apart in the scan.
    """
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("line", "first", "second")).alias("lines"))
    rows = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = maybe_in(rows, "doc", wanted.select("doc")).join(per_doc, "doc")
    lines = rows.select("doc", F.split("text", "\n").alias("split"), F.explode("lines").alias("x"))
    return lines.select("doc", "x.line", "x.first", "x.second", F.get("split", F.col("x.line")).alias("text")).where(F.col("text").isNotNull())


def _variants(candidates: DataFrame) -> DataFrame:
    """Rows (key, at, doc, line): the line without word ``at``, or the line itself with ``at`` = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("line_dedup.variants")
        for batch in batches:
            docs_, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for begin in range(0, batch.num_rows, 2000):
                keys, ats, row = [], [], []
                for i in range(begin, min(begin + 2000, batch.num_rows)):
                    words = word_bytes(batch.column(4)[i].as_py())
                    if len(words) < 2:
                        continue
                    k, at = variant_keys(words, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                    keys += [np.array([full_key(words)], np.int64), k]
                    ats += [np.array([-1]), at]
                    row.append((i, len(k) + 1))
                if keys:
                    which = np.repeat(np.array([i for i, _ in row]), [n for _, n in row])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ats).astype(np.int32)), pa.array(docs_[which]), pa.array(lines[which].astype(np.int32))], names=["key", "at", "doc", "line"])

    return candidates.mapInArrow(run, f"key long, at int, {_LINE}")


def near_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct lines at their earliest place (doc, line, n, copies), and links from lines to an earlier duplicate."""
    distinct = materialise(_distinct(_scan(docs, id_col, text_col, min_words)), "lines")
    halves_ = distinct.where(F.col("k0").isNotNull()).select(
        "doc", "line", F.explode(F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(i % 2 == 0).alias("is_first")) for i in range(4)))).alias("k")
    ).select("doc", "line", "k.key", "k.is_first").where(F.col("key").isNotNull())
    shared = halves_.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = halves_.join(shared, "key").groupBy("doc", "line").agg(F.bool_or("is_first").alias("first"), F.bool_or(~F.col("is_first")).alias("second"))
    candidates = materialise(_candidates(docs, materialise(wanted, "wanted"), id_col, text_col), "candidates")
    variants = materialise(_variants(candidates), "variants")
    # of the lines that leave out the same word of a key, the earliest; and lines that are the key
    by_word = variants.where("at >= 0").groupBy("key", "at").agg(F.min(place(F.col("doc"), F.col("line"))).alias("early"), F.count("*").alias("n")).where("n > 1")
    by_word = materialise(by_word, "by-word")
    found = join_hot(variants, by_word.drop("n"), ["key", "at"], ["doc", "line"], by_word.select("key", "at", "n")).select(place(F.col("doc"), F.col("line")).alias("late"), "early")
    whole = variants.where("at = -1").select("key", place(F.col("doc"), F.col("line")).alias("whole"))
    shorter = variants.where("at >= 0").join(whole, "key")
    here = place(F.col("doc"), F.col("line"))
    longer = shorter.where(here > F.col("whole")).select(here.alias("late"), F.col("whole").alias("early"))
    back = shorter.where(here < F.col("whole")).groupBy("whole").agg(F.min(here).alias("early")).select(F.col("whole").alias("late"), "early")
    links = found.unionByName(longer).unionByName(back).where(F.col("early") < F.col("late")).distinct()
    return distinct, _verified(candidates, materialise(links, "line-links"))


def _verified(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose two lines are within one edit."""
    texts = candidates.select(place(F.col("doc"), F.col("line")).alias("at"), "text")

    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        worker_state("line_dedup.verified")
        return pa.array([within_one(word_bytes(x.as_py()), word_bytes(y.as_py())) for x, y in zip(a, b)], pa.bool_())

    pairs = join_hot(links, texts.select(F.col("at").alias("early"), F.col("text").alias("b")), ["early"], ["late"]).join(texts.select(F.col("at").alias("late"), F.col("text").alias("a")), "late")
    return pairs.where(close("a", "b")).select("late", "early").distinct()


def kept_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that keeps a line with words: ``doc`` and the sorted places ``kept`` of those lines."""
    distinct, links = near_lines(docs, min_words, id_col, text_col)
    gone = links.select(F.col("late.doc").alias("doc"), F.col("late.line").alias("line")).distinct()
    left = distinct.select("doc", "line").join(gone, ["doc", "line"], "left_anti")
    return left.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("kept"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_lines (with words), n_kept, text_sha256 of the text that is left."""
    out = _applied(docs, kept_lines(docs, min_words, id_col, text_col), id_col, text_col)
    return out.select(F.col("c0").alias(id_col), "n_lines", "n_kept", F.sha2(F.col("left").cast("binary"), 256).alias("text_sha256"))


def _applied(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str, every: bool = False) -> DataFrame:
    """Columns c0.. of ``docs`` (id and text only, or all), with n_lines, n_kept and ``left``, the text that stays."""
    rows = docs if every else pick(docs, id_col, text_col)
    names = list(rows.columns)
    inner = rows.toDF(*(f"c{i}" for i in range(len(names))))
    id_, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    joined = inner.join(kept, id_.cast("long") == F.col("doc"), "left")

    @F.arrow_udf("struct<n_lines:long,n_kept:long,left:string>")
    def apply(texts: pa.Array, lists: pa.Array, whole: pa.Array) -> pa.Array:
        worker_state("line_dedup.applied")
        out = []
        for t, k, w in zip(texts, lists, whole):
            lines = (t.as_py() or "").split("\n")
            keep = None if w.as_py() else set(k.as_py() or ())
            has = [bool(word_bytes(line)) for line in lines]
            stay = [not h or keep is None or i in keep for i, h in enumerate(has)]
            out.append((sum(has), sum(h and s for h, s in zip(has, stay)), "\n".join(line for line, s in zip(lines, stay) if s)))
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["n_lines", "n_kept", "left"])

    return joined.withColumn("a_", apply(text, F.col("kept"), id_.isNull())).select(*inner.columns, "a_.*")


def drop_duplicates(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with duplicate lines taken out; those that lose all their lines with words go."""
    names = list(docs.columns)
    out = _applied(docs, kept_lines(docs, min_words, id_col, text_col), id_col, text_col, every=True)
    out = out.where((F.col("n_lines") == 0) | (F.col("n_kept") > 0))
    at = names.index(text_col)
    return out.select(*((F.when(F.col(f"c{i}").isNotNull(), F.col("left")) if i == at else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)))
