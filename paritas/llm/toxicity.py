"""Toxicity by classifier chains.

Categories are predicted one after the other. The linear model of a category sees the words of a text and the
probabilities of all earlier categories; in training those are out-of-fold predictions, so that later models
learn from what they will be given. Models are logistic regressions with an L1 penalty over hashed words and
word beginnings; the penalty leaves few features, so that long clean texts do not add up to anything.

The categories are those that the table of labels can tell (``CATEGORIES``: expressions over its columns). Fitted on
the ``train_docs`` labelled documents of least hash of their id (a documented bound; whole texts). The folds of a
category and its final model are fitted in tasks of their own, side by side; the driver only passes on what they
give. All documents are scored over whole texts in one scan, without a shuffle; the model that is sent has at most
2 * DIMENSIONS weights a category.

Defined results: null and empty texts have no features and get the models' base rates; with no labelled rows
all probabilities are 0; a category with one value in all rows has that value as its probability (but for rounding);
rows of ``labels`` without a text, with a null id or a null in any category are not learned from; a document with
several rows of labels is in a category if one of them says so; repeated rows are each scored, and learned from as
often as they are there; ties at the threshold are toxic.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm.common import pick, word_bytes, worker_state

DIMENSIONS = 1 << 17
TRAIN_DOCS, FOLDS, THRESHOLD = 3000, 3, 0.5
#: Least first gradient, on the scale of the penalty, of a feature that is fitted.
SCREEN = 3.0

#: In the order of the chain: name, and the category as an expression over the columns of the labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 AND quality = 0"))


def word_features(word: bytes) -> tuple[int, ...]:
    """A word, and its first four and five characters where it has more."""
    text = word.decode("utf-8", "replace")
    parts = [b"w" + word] + [b"p%d" % n + text[:n].encode() for n in (4, 5) if len(text) > n]
    return tuple(xxhash.xxh32_intdigest(p) % DIMENSIONS for p in parts)


def features(text: str | None, known: dict[bytes, tuple[int, ...]]) -> list[int]:
    """Distinct features of a text. ``known``: a bounded cache of words."""
    found: set[int] = set()
    if len(known) > 200_000:
        known.clear()
    for word in set(word_bytes(text)):
        got = known.get(word)
        if got is None:
            got = word_features(word)
            if len(word) <= 64:
                known[word] = got
        found.update(got)
    return sorted(found)


@dataclass
class Linear:
    """Weights of features, of earlier probabilities, and the intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float


class Sparse:
    """Rows of distinct feature numbers, all of value 1."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.columns], minlength=self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, weights=r[self.row], minlength=size)

    def take(self, mask: np.ndarray) -> Sparse:
        out = Sparse([])
        place = np.cumsum(mask) - 1
        keep = mask[self.row]
        out.n, out.columns, out.row = int(mask.sum()), self.columns[keep], place[self.row[keep]]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: Sparse, earlier: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 80) -> Linear:
    """L1-penalised logistic regression by accelerated proximal steps; the intercept is not penalised."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Linear(np.zeros(DIMENSIONS), np.zeros(earlier.shape[1]), 40.0 if p == 1 else -40.0)
    size, extra = DIMENSIONS, earlier.shape[1]
    used, codes = np.unique(x.columns, return_inverse=True)
    counts = np.bincount(codes)
    # a feature whose first gradient is small is not looked at; sums, not products: BLAS threads would spin
    first = np.abs(np.bincount(codes, weights=(y - y.mean())[x.row])) * np.sqrt(len(y) / counts).clip(max=20)
    frequent = (counts >= 4) & (first > SCREEN)
    place = np.cumsum(frequent) - 1
    keep = frequent[codes]
    small = Sparse([])
    small.n, small.columns, small.row = x.n, place[codes[keep]], x.row[keep]
    m = int(frequent.sum())
    w = np.zeros(m + extra + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    # features scaled by the root of their frequency: steps of like size for rare and for common words
    scale = np.concatenate((np.sqrt(len(y) / counts[frequent]).clip(max=20) if m else np.zeros(0), np.full(extra, 4.0), [1.0]))
    v, t = w.copy(), 1.0

    def margins(w: np.ndarray) -> np.ndarray:
        u = w * scale
        return small.dot(u[:m]) + (earlier * u[m : m + extra]).sum(axis=1) + u[-1]

    step = 4.0 / (len(y) * (1 + extra * 4) + (np.bincount(small.row, weights=(scale[:m] ** 2)[small.columns], minlength=small.n)).max())
    loss = lambda z: np.logaddexp(0, z).sum() - (y * z).sum()
    for _ in range(steps):
        z = margins(v)
        r = sigmoid(z) - y
        g = np.concatenate((small.back(r, m), (earlier * r[:, None]).sum(axis=0), [r.sum()])) * scale
        base = loss(z)
        step *= 1.15
        while True:
            new = v - step * g
            limit = step * penalty
            new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - limit, 0)
            d = new - v
            if loss(margins(new)) <= base + (g * d).sum() + (d * d).sum() / (2 * step) + 1e-9:
                break
            step /= 2
        if ((v - new) * (new - w)).sum() > 0:  # the momentum points uphill: start it anew
            t = 1.0
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nxt * (new - w)
        w, t = new, nxt
    u = w * scale
    full = np.zeros(size)
    full[used[frequent]] = u[:m]
    return Linear(full, u[m : m + extra], float(u[-1]))


class Chain:
    def __init__(self, names: tuple[str, ...], models: list[Linear]):
        self.names, self.models = names, models
        self.active = np.flatnonzero(sum((np.abs(m.weights) for m in models), np.zeros(DIMENSIONS)))
        self.compact = {int(f): [float(m.weights[f]) for m in models] for f in self.active}
        self.heads = [(m.earlier.tolist(), m.bias) for m in models]

    def probabilities(self, found: list[list[float]]) -> list[float]:
        """Of the weights of a text's features."""
        sums = [sum(c) for c in zip(*found)] if found else [0.0] * len(self.heads)
        out: list[float] = []
        for s, (earlier, bias) in zip(sums, self.heads):
            z = s + bias + sum(a * b for a, b in zip(earlier, out))
            out.append(float(1 / (1 + np.exp(-max(-40.0, min(40.0, z))))))
        return out


def _job(x: Sparse, seen: np.ndarray, y: np.ndarray, folds: np.ndarray, fold: int | None) -> Linear | np.ndarray:
    """The model of all rows; or what one of the other folds says about the rows of ``fold``."""
    if fold is None:
        return fit_linear(x, seen, y)
    inside = folds != fold
    part = fit_linear(x.take(inside), seen[inside], y[inside])
    return sigmoid(x.take(~inside).dot(part.weights) + (seen[~inside] * part.earlier).sum(axis=1) + part.bias)


def train(rows: list[np.ndarray], labels: np.ndarray, names: tuple[str, ...], folds: np.ndarray, run: Callable | None = None) -> Chain:
    """``labels``: a column per category; ``folds``: the fold of each row.

    ``run``: from the arguments that the jobs of a category share, and their folds, to what the jobs give.
    """
    run = run or (lambda shared, wanted: [_job(*shared, fold) for fold in wanted])
    x, models = Sparse(rows), []
    seen = np.zeros((x.n, 0))
    for k in range(len(names)):
        some = np.unique(folds).tolist() if k + 1 < len(names) else []
        model, *told = run((x, seen, labels[:, k].astype(float), folds), [None, *some])
        models.append(model)
        out = np.zeros(x.n)
        for fold, p in zip(some, told):
            out[folds == fold] = p
        seen = np.column_stack((seen, out))
    return Chain(names, models)


def in_tasks(spark: SparkSession) -> Callable:
    """Jobs as Spark tasks, one each."""

    def run(shared: tuple, wanted: list[int | None]) -> list:
        sent = spark.sparkContext.broadcast(shared)  # of at most ``train_docs`` documents

        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state("toxicity.fit")
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pickle.dumps(_job(*sent.value, wanted[at]))], pa.binary())], names=["at", "told"])

        told = spark.range(0, len(wanted), 1, len(wanted)).mapInArrow(job, "at long, told binary").collect()
        sent.unpersist()
        return [pickle.loads(bytes(r["told"])) for r in sorted(told, key=lambda r: r["at"])]

    return run


def fit(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", categories: tuple[tuple[str, str], ...] = CATEGORIES
) -> Chain | None:
    """The chain, fitted on a bounded sample; None without labelled rows."""
    spark = docs.sparkSession
    named = [f"y{k}" for k in range(len(categories))]
    known = labels.select(F.col(id_col).alias("id"), *(F.expr(rule).cast("int").alias(n) for n, (_, rule) in zip(named, categories))).dropna()
    known = known.groupBy("id").agg(*(F.max(n).alias(n) for n in named))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(train_docs)  # bounded, so broadcast
    rows = pick(docs, id_col, text_col).toDF("id", "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        cache: dict = {}
        for batch in batches:
            found = [features(t.as_py(), cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], names=["id", "f", *named])

    kind = dict(rows.dtypes)["id"]
    got = rows.join(F.broadcast(sample), "id").select("id", "text", *named).mapInArrow(run, f"id {kind}, f array<int>, " + ", ".join(f"{n} int" for n in named)).toArrow()
    if not got.num_rows:
        return None
    ids = got.column("id").to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (xxhash.xxh64_intdigest(str(ids[i])), i)))
    f = got.column("f").to_pylist()
    columns = np.column_stack([got.column(n).to_numpy()[order] > 0 for n in named])
    return train([np.array(f[i], np.int64) for i in order], columns, tuple(n for n, _ in categories), np.arange(len(ids)) % folds, in_tasks(spark))


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", decide: str = "toxic") -> DataFrame:
    """Per document: id, a probability ``p_<category>`` for each category of the chain, and whether ``decide``'s reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    names = list(chain.names) if chain else [n for n, _ in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        chain = sent.value
        weights: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for t in batch.column(1):
                if chain is None:
                    out.append([0.0] * len(names))
                    continue
                if len(weights) > 200_000:
                    weights.clear()
                active: set[int] = set()
                for word in set(word_bytes(t.as_py())):
                    got = weights.get(word)
                    if got is None:
                        got = tuple(f for f in word_features(word) if f in chain.compact)
                        if len(word) <= 64:
                            weights[word] = got
                    if got:
                        active.update(got)
                out.append(chain.probabilities([chain.compact[f] for f in sorted(active)]))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=[id_col, *(f"p_{n}" for n in names)])

    scored = rows.mapInArrow(run, f"{id_col} {id_type}, " + ", ".join(f"p_{n} double" for n in names))
    return scored.select(id_col, (F.col(f"p_{decide}") >= threshold).alias(decide), *(f"p_{n}" for n in names))
