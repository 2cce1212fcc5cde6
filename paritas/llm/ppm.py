"""Language identification by partial matching.

For each language a byte context tree of variable order is counted on a bounded sample of labelled documents
and then frozen. The code length of a text under a language is the sum over its bytes: from the longest
context that the tree has, a byte that was seen there costs -log2(n / (N + D)), one that was not costs an
escape of -log2(D / (N + D)) and is looked for in the next shorter context; below order 0 each byte costs
8 bits. (N: occurrences of the context, D: distinct bytes after it.) The shortest total wins.

Code lengths are exact over whole texts. A worker looks up each distinct run of order + 1 bytes once per
slice of texts and adds up per document. Texts are scored in one scan without a shuffle.

The sample: per language the ``train_docs`` distinct training documents of least hash of id and text, read whole.
No other step is bounded: all texts are scored whole.

Defined results: null texts and texts without a letter get ``und`` with score 0; if there is nothing to learn
from, all get ``und``; repeated rows are each scored, and learned from once; null ids and languages are allowed (a
null language is not learned from, nor is a null id); equal code lengths go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.llm.common import has_letter, pick, worker_state

ORDER = 4
#: Documents learned from, of each language.
TRAIN_DOCS = 400
UNKNOWN = "und"
#: Bytes scored together.
SLICE = 4_000_000


def prepared(text: str) -> bytes:
    """Lower case, so that headlines count like prose, and single blanks for white space."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(raw: bytes, order: int) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it, packed; blanks before the start."""
    x = np.frombuffer(b" " * order + raw, np.uint8).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | x[i : i + len(raw)]
    return out


class Tree:
    """The frozen statistics of one language: per order, sorted packed grams with their code lengths."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels, self.total = order, [], int(counts.sum())
        for k in range(order + 1):
            keys, back = np.unique(packed & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(back, weights=counts)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, weights=n), np.bincount(of)
            cost = -np.log2(n / (total + kinds)[of])
            escape = -np.log2(kinds / (total + kinds))
            self.levels.append((keys, cost, contexts, escape))

    def cost(self, packed: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the bytes before it."""
        bits, left = np.zeros(len(packed)), np.arange(len(packed))
        for k in range(self.order, -1, -1):
            keys, cost, contexts, escape = self.levels[k]
            gram = packed[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            seen = keys[at] == gram
            bits[left[seen]] += cost[at[seen]]
            left, gram = left[~seen], gram[~seen] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, gram), len(contexts) - 1)
            known = contexts[at] == gram
            bits[left[known]] += escape[at[known]]
            if not len(left):
                break
        bits[left] += 8
        return bits


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.order = order
        self.languages = sorted(counts)
        self.trees = [Tree(*counts[lang], order) for lang in self.languages]

    def lengths(self, raws: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        import pandas as pd

        out = np.zeros((len(raws), len(self.trees)))
        at = 0
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and (end == at or size + len(raws[end]) <= SLICE):
                size += len(raws[end])
                end += 1
            if end == at + 1 and len(raws[at]) > SLICE:  # a very long text, piece by piece with its context
                raw = raws[at]
                for i in range(0, len(raw), SLICE):
                    packed = grams(raw[max(0, i - self.order) : i + SLICE], self.order)[min(i, self.order) :]
                    codes, distinct = pd.factorize(packed)
                    out[at] += np.array([(tree.cost(distinct) * np.bincount(codes, minlength=len(distinct))).sum() for tree in self.trees])
            else:
                some = [r for r in raws[at:end] if r]
                if some:
                    codes, distinct = pd.factorize(np.concatenate([grams(r, self.order) for r in some]))
                    starts = np.cumsum([0] + [len(r) for r in some[:-1]])
                    rows = [i for i in range(at, end) if raws[i]]
                    for k, tree in enumerate(self.trees):
                        out[rows, k] = np.add.reduceat(tree.cost(distinct)[codes], starts)
            at = end
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability under equal priors."""
        fit = [bool(t) and has_letter(t) and bool(self.trees) for t in texts]
        lengths = self.lengths([prepared(t) if ok else b"" for t, ok in zip(texts, fit)]) if self.trees else None
        out = []
        for i, ok in enumerate(fit):
            if not ok:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(lengths[i].argmin())
            out.append((self.languages[best], float(1 / np.exp2(np.minimum(lengths[i][best] - lengths[i], 0)).sum())))
        return out


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the trees on the sample; its documents are chosen first, by hash, then only their texts go to Python."""
    rows = pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # by the size of a language, a bound on the hash under which four times the wanted documents lie: no task ranks more
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    bounds = [F.when(F.col("lang") == lang, F.lit(min((1 << 63) - 1, int((1 << 64) * 4 * train_docs / n) - (1 << 63)))) for lang, n in sizes.items()]
    hashed = rows.withColumn("hash", F.xxhash64("id", "text"))
    few = hashed.where(F.col("hash") <= F.coalesce(*bounds) if bounds else F.lit(False)).select("lang", "hash").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= train_docs).select("lang", "hash")
    last = {r[0]: r[1] for r in chosen.groupBy("lang").agg(F.max("hash")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ppm")
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                raw = prepared(text.as_py())
                for at in range(0, len(raw), SLICE):  # a very long text, piece by piece with its context
                    packed, n = np.unique(grams(raw[max(0, at - order) : at + SLICE], order)[min(at, order) :], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(n)), pa.array(packed.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    if not last:
        return Model({}, order)
    within = [F.when(F.col("lang") == lang, F.lit(most)) for lang, most in last.items()]
    sample = hashed.where(F.col("hash") <= F.coalesce(*within)).dropDuplicates(["lang", "hash"])
    found = sample.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    table = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, packed, n = table.column("lang").to_numpy(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return Model({str(lang): (packed[langs == lang], n[langs == lang].astype(float)) for lang in sorted(set(langs))}, order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score. One scan, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ppm")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = sent.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{id_col} {id_type}, lang_pred string, score double")
