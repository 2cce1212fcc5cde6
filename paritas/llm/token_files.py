"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded, and written as ORC: stripes with run-length
encoded integers, row indexes, and Bloom filters on the document ids. Readers take stripes in parallel and
skip by the metadata (``lookup``).

The text is what is shuffled, once; it compresses better than ids. Ids are made after the sort, a task at a
time, and go straight into the file. Prefix sums come from the files' own counts: a window in each file, and
one row per file for the offsets.

Words are encoded one by one and kept in a bounded cache where the vocabulary has the normaliser and the splitter
that this is right for (``WORD_RULES``, compared when the files are written); with any other vocabulary the library
encodes whole texts.

Defined results: a null text is an empty one (only the end id); documents with equal ids stay apart, and their
``start`` follows their places in the file (any order among themselves); null ids come first; an empty table gives
an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.llm.common import free_name, new_path, pick, worker_state

END_ID = 1
#: Words that a worker keeps the ids of, and the longest such word.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 48


#: Where an ASCII mark follows a letter a-z the splitter always cuts.
_MARK = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")
#: Plain prose: nothing but these, and no two marks together.
_PLAIN = b"abcdefghijklmnopqrstuvwxyz ,.\n"


def words_of(text: str | None) -> list[bytes]:
    """Pieces of a text between which the tokenizer always cuts: words in lower case, and marks that follow one."""
    raw = text.encode("utf-8", "replace") if text else b""
    if b"<|" in raw:
        return raw.split()
    raw = raw.lower()
    if not raw.translate(None, _PLAIN) and b",," not in raw and b".." not in raw and b",." not in raw and b".," not in raw:
        return raw.replace(b",", b" ,").replace(b".", b" .").split()
    return _MARK.sub(b" ", raw).split()


#: How the byte level of the vocabulary writes bytes: visible Latin-1 characters stand for themselves, the others, in
#: order, for the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _as_bytes(word: bytes) -> str | None:
    """What the normaliser and the splitter make of a word of lower-case Latin letters; None for any other word."""
    if word.isalpha() and word.islower():
        return word.decode()
    text = word.decode()
    if text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text):
        return word.decode("latin-1").translate(_BYTE_LEVEL)
    return None


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit integers; a word that is not there is encoded when it is asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        plain = _as_bytes(word)
        ids = [t.id for t in self.tokenize(plain)] if plain is not None else self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        raw = pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_BYTES:
            self[word] = raw
        return raw


#: The parts of a tokenizer's file for which ``words_of`` and ``_as_bytes`` hold.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}


def word_by_word(spec: str) -> bool:
    """Whether a text's ids are those of its words: the rules are ``WORD_RULES``, and special tokens begin with "<|"."""
    found = json.loads(spec)
    model = found.get("model") or {}
    return (
        all(found.get(k) == v for k, v in WORD_RULES.items()) and model.get("type") == "BPE" and not model.get("dropout")
        and all(t["content"].startswith("<|") and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in found.get("added_tokens") or [])
    )


class WordCachedEncoder:
    """Ids of the tokenizers library, word by word.

    The vocabulary's normaliser and splitter treat ASCII white space as a border that no token crosses, cut
    between a letter and a mark, and lower the case, so a text's ids are those of its words, in order. Words met
    before come from a bounded cache. A text with the start of a special token keeps its case. A vocabulary with other
    rules encodes texts as a whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.ids = WordIds(self.tokenizer) if word_by_word(spec) else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        if self.ids is None:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        for text in texts:
            if len(self.ids) > CACHE_WORDS:
                self.ids.clear()
            out.append(b"".join(map(self.ids.__getitem__, words_of(text))))
        return out


def _encoder(spec) -> WordCachedEncoder:
    state = worker_state("token_files")
    if spec.id not in state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state[spec.id] = WordCachedEncoder(spec.value)
    return state[spec.id]


class _Sent:
    def __init__(self, spark: SparkSession, value: str):
        import hashlib

        self.sent, self.id = spark.sparkContext.broadcast(value), hashlib.sha256(value.encode()).hexdigest()

    @property
    def value(self) -> str:
        return self.sent.value


def write(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write them to ``path`` in ascending id order; returns the path.

    ``vocabulary``: the tokenizer's JSON file on the driver. Columns: ``file`` (place in the order), ``row`` (place in
    the file), the id, ``ids`` (array of ints). A task that is run again writes its file anew; only committed files count.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    with open(vocabulary, encoding="utf-8") as f:
        spec = _Sent(spark, f.read())
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()
    # the number must not be merged away: a partition becomes a file
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(n, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        encoder, row = _encoder(spec), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds what is held as ids
                part = batch.slice(at, 500)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([file] * part.num_rows, pa.int32()), pa.array(np.arange(row, row + part.num_rows)), part.column(0), lists], names=["file", "row", id_col, "ids"])
                row += part.num_rows

    out = rows.mapInArrow(run, f"file int, row bigint, {id_col} {id_type}, ids array<int>")
    options = {"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "lz4"}
    out.write.options(**options).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; splits are stripes, so tasks read stripes of one file in parallel."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, ids: list, id_col: str = "doc_id") -> DataFrame:
    """The rows of a few documents: the filter is pushed to the stripes' statistics and Bloom filters."""
    return read(spark, path).where(F.col(id_col).isin(ids))


def document_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = read(spark, path).select("file", "row", id_col, "ids")
    id_type = rows.schema[2].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("document_index")
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], names=["file", "row", id_col, "n_tokens", "ids_crc32"])

    counts = rows.mapInArrow(run, f"file int, row bigint, {id_col} {id_type}, n_tokens bigint, ids_crc32 bigint")
    before = free_name([id_col, "file", "row", "n_tokens", "ids_crc32", "start"], "before")
    files = rows.groupBy("file").agg(F.sum(F.size("ids")).alias("total"))
    running = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))  # one row per file
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(running, "file").select(id_col, (F.col("start") + F.col(before)).alias("start"), "n_tokens", "ids_crc32")
