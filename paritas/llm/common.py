"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII and its lower case, for ``translate``: only A-Z change.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What is no part of a word of ASCII letters, digits and other scripts.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used in local mode; on a cluster that is an error, as executors
    would write to folders that no one else sees.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="paritas-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch, whichever is reached first (one row at least): a batch is held in memory on both
#: sides, and a few long texts weigh as much as many short ones.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}

_state: dict = {}


def worker_state(owner: str) -> dict:
    """What a Python worker keeps between tasks of one operator, or of one step of it.

    Workers outlive operators; when another owner begins, what the last one kept or left is given back to the system.
    """
    if _state.get("owner") != owner:
        used = bool(_state)
        _state.clear()
        _state["owner"] = owner
        if used:
            give_back()
    return _state


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES``, unless they are lower."""
    for name, most in _BATCH_CONF.items():
        now = spark.conf.get(name, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


#: A key is hot if it holds over one in so many rows; so there are at most so many hot keys, whatever the data.
HOT_KEYS, SALTS = 1000, 64


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``many`` (a table that is cheap to read again) with ``one``, whose rows are few a key.

    Hot keys are dealt to ``SALTS`` tasks by a hash of the columns ``spread``, and their rows of ``one`` to each of them.
    ``sizes``: ``keys`` and ``n`` in a written table, if the rows of each key (or of all that have several) are known. Only the hot keys, at most ``HOT_KEYS``, are broadcast.
    """
    total = many.count() if sizes is None else sizes.agg(F.sum("n")).first()[0] or 0
    if sizes is None:
        sizes = many.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = F.broadcast(sizes.where(F.col("n") > total / HOT_KEYS).select(*keys, F.lit(True).alias("hot_")))
    salt = F.when(F.col("hot_"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, keys, "left").withColumn("salt_", salt).drop("hot_")
    right = one.join(hot, keys, "left").withColumn("salt_", F.explode(salts)).drop("hot_")
    return left.join(right, [*keys, "salt_"]).drop("salt_")


#: Words of 64 bits in a table of bits: 2 MB, whatever the data.
BIT_WORDS = 1 << 18


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys`` (none that is goes).

    Hashes of the keys set bits in a table of fixed size, which is broadcast; rows whose bit is not set go in the
    scan, before any shuffle. Where keys are so many that all bits are set, all rows stay.
    """
    name, place = keys.columns[0], lambda c: F.xxhash64(c).bitwiseAND(F.lit(BIT_WORDS * 64 - 1))
    hashed = keys.select(place(F.col(name)).alias("h_"))
    bits = hashed.groupBy(F.shiftright("h_", 6).alias("w_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h_ & 63 as int))")).alias("b_"))
    joined = rows.withColumn("p_", place(F.col(key))).join(F.broadcast(bits), F.shiftright("p_", 6) == F.col("w_"))
    return joined.where(F.expr("shiftright(b_, cast(p_ & 63 as int)) & 1L") == 1).select(*rows.columns)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column has that name (case ignored)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact name first; other columns may clash in case without harm."""
    small_batches(df.sparkSession)
    places = []
    for name in names:
        found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name!r} in {df.columns}")
        places.append(found[0])
    inner = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return inner.select(*(F.col(f"c{i}").alias(name) for i, name in zip(places, names)))


def with_column(df: DataFrame, source: str, to: str, f) -> DataFrame:
    """``df`` with ``f`` of the column ``source`` as ``to`` (in place, if there is one of exactly that name)."""
    small_batches(df.sparkSession)
    names = list(df.columns)
    inner = df.toDF(*(f"c{i}" for i in range(len(names))))
    new = f(F.col(f"c{names.index(source)}"))
    if to in names:
        return inner.select(*(new.alias(n) if n == to else F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
    return inner.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), new.alias(to))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_bytes(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all other scripts, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().translate(_BLANK).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "replace").split() if text else []


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None
