"""Byte-level BPE encoding and decoding in DuckDB, a partition at a time.

Each partition splits its texts into pieces and hands the distinct pieces that its worker has not met yet to
one recursive DuckDB query: token-position rows join the merge table, each piece's leftmost pair of least rank
is contracted, until no pair is left that can be. Decoding joins ids with the vocabulary and aggregates their
bytes in order. No shuffle; a worker's tables and caches have fixed bounds and rebuild themselves after a loss.

The recursion writes all tokens of a piece that is not done anew in each step, so its rows grow with the square of
the piece. A piece of over ``WINDOW`` bytes is therefore contracted in overlapping windows. Where the ids of two
windows have one token in common, at the same place, no merge of the whole piece crosses either end of that token:
a merge across an end would depend only on what stands between the ends and beyond this one, all of which one of the
two windows holds, and neither made it. So the tokens up to there and those after it are the whole piece's. Where two
windows have no such token, a longer one that begins with a token found so far takes their place, in the end one from
the first byte. Every id comes out of the recursive query, and time is linear in the length of a piece.

Defined results: a null text is an empty one with no tokens; repeated rows are each encoded; an empty table
gives an empty one. Only the id and text columns are read. A text of any length is handled in bounded runs of
pieces.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from paritas.llm.common import pick, with_column, worker_state

#: Bytes of the windows of a long piece, and from one to the next.
WINDOW, STRIDE = 128, 64
#: Pieces that a worker keeps; characters of the longest; pieces of texts handled together; token rows in one query.
CACHE_PIECES, CACHE_CHARS, RUN, ROWS = 700_000, 64, 200_000, 100_000
#: Characters of the texts that are encoded together; a longer one goes by itself, in runs.
GROUP = 2_000_000

ENCODE = """
WITH RECURSIVE t AS (
    SELECT 0 AS step, word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos
    FROM seed WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    SELECT t.step + 1, t.word, t.pos,
        CASE WHEN t.pos = b.at THEN b.rank ELSE t.tok END,
        CASE WHEN t.pos = b.at THEN b.nxt WHEN t.npos = b.at THEN b.rank ELSE t.nxt END,
        CASE WHEN t.pos = b.at THEN b.npos ELSE t.npos END
    FROM t JOIN (
        SELECT a.word, a.best % 4294967296 AS at, (a.best // 4294967296)::INTEGER AS rank, a.gone, r.nxt, r.npos
        FROM (
            SELECT word, min(m.rank::BIGINT * 4294967296 + pos) AS best, arg_min(npos, m.rank::BIGINT * 4294967296 + pos) AS gone
            FROM t JOIN merges AS m ON m.l = tok AND m.r = nxt GROUP BY word
        ) AS a JOIN t AS r ON r.word = a.word AND r.pos = a.gone
    ) AS b ON t.word = b.word AND t.pos <> b.gone
)
SELECT word, tok FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step) ORDER BY word, pos
"""

DECODE = "SELECT run, string_agg(v.hex, '' ORDER BY i.pos) AS hex FROM ids AS i JOIN vocabulary AS v ON v.id = i.tok GROUP BY run ORDER BY run"


class Codec:
    """Encoder and decoder of one vocabulary of ranks, as a worker holds it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace("\\s", r"\p{White_Space}").replace("\\S", r"\P{White_Space}"))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({n: pa.array(c, pa.int32()) for n, c in zip("l r rank".split(), zip(*pairs) if pairs else ([], [], []))})
        self.con.register("tokens_", tokens)
        self.con.register("merges_", merges)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens_; CREATE TABLE merges AS SELECT * FROM merges_")
        self.con.unregister("tokens_"), self.con.unregister("merges_")
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.ids: dict[str, bytes] = {}

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces, by the recursive query, in groups of bounded size."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(pieces):
            end, rows = at, 0
            while end < len(pieces) and (end == at or rows + len(pieces[end]) <= ROWS):
                rows += len(pieces[end])
                end += 1
            part = pieces[at:end]
            sizes = np.array([len(p) for p in part])
            flat = np.frombuffer(b"".join(part), np.uint8)
            starts = np.cumsum(sizes) - sizes
            seed = pa.table({"word": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.int32), "tok": self.byte[flat]})
            self.con.register("seed", seed)
            got = self.con.execute(ENCODE).fetchnumpy()
            self.con.unregister("seed")
            words, toks = np.asarray(got["word"]), np.asarray(got["tok"]).astype("<u4")
            out += np.split(toks, np.searchsorted(words, np.arange(1, len(part))))
            at = end
        return out

    def _windows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of over ``WINDOW`` bytes: their windows share queries, then each piece is put together."""
        places = [(k, s) for k, p in enumerate(pieces) for s in range(0, len(p) - WINDOW + STRIDE, STRIDE)]
        found: list[list[tuple[int, np.ndarray]]] = [[] for _ in pieces]
        for (k, s), ids in zip(places, self._contract([pieces[k][s : s + WINDOW] for k, s in places])):
            found[k].append((s, ids))
        return [self._joined(p, windows) for p, windows in zip(pieces, found)]

    def _joined(self, piece: bytes, windows: list[tuple[int, np.ndarray]]) -> bytes:
        """The ids of a piece from those of its windows: (first byte, ids)."""
        starts: list[int] = []  # of the tokens of piece[:done]
        ids: list[int] = []
        done, retry = 0, 2 * WINDOW

        def take(first: int, part: np.ndarray) -> bool:
            """Go on with a window's tokens behind one that both have."""
            nonlocal done
            sizes = self.size[part]
            ends = first + np.cumsum(sizes)
            begins = (ends - sizes).tolist()
            some = 0
            if first:
                for some, begin in enumerate(begins, 1):
                    at = bisect_left(starts, begin)
                    if at < len(starts) and starts[at] == begin and ids[at] == part[some - 1]:
                        break
                else:
                    return False
                del starts[at + 1 :], ids[at + 1 :]
            else:
                starts.clear(), ids.clear()
            starts.extend(begins[some:]), ids.extend(part[some:].tolist())
            done = int(ends[-1])
            return True

        for s, part in windows:
            if done and (s + WINDOW <= done or done == len(piece)):
                continue
            if take(s, part):
                retry = max(2 * WINDOW, retry // 2)
                continue
            size = retry  # grows while windows fail, so that few are tried
            while True:
                first = starts[max(0, bisect_left(starts, done - size // 2) - 1)]
                if take(first, self._contract([piece[first : done + size // 2]])[0]):
                    break
                size *= 2
            retry = min(2 * size, 8 * WINDOW)
        return np.array(ids, "<u4").tobytes()

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, so many at a time."""
        if len(text) <= RUN:
            yield self.pattern.findall(text)
            return
        run: list[str] = []
        for m in self.pattern.finditer(text):
            run.append(m.group())
            if len(run) == RUN:
                yield run
                run = []
        yield run

    def encode_pieces(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces, as little-endian unsigned 32-bit integers; pieces not met yet share a query."""
        every = set().union(*lists)
        new = every.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_PIECES:
            self.ids.clear()
            new = every
        extra: dict[str, bytes] = {}
        short: list[str] = []
        long: list[str] = []
        for p in new:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.ids[p] = r.to_bytes(4, "little")
            else:
                (long if len(raw) > WINDOW else short).append(p)
        for p, ids in zip(short, self._contract([p.encode() for p in short])):
            (self.ids if len(p) <= CACHE_CHARS else extra)[p] = ids.tobytes()
        extra.update(zip(long, self._windows([p.encode() for p in long])))
        known = self.ids
        if extra:
            return [b"".join([known[p] if p in known else extra[p] for p in pieces]) for pieces in lists]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]

    def encode_runs(self, text: str) -> Iterator[bytes]:
        for run in self.runs(text):
            yield self.encode_pieces([run])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_runs(text)), "<u4").tolist()

    def decode_runs(self, runs: list[bytes]) -> list[bytes]:
        """Bytes of runs of ids, by ordered aggregation."""
        out: list[bytes] = []
        at = 0
        while at < len(runs):
            end, rows = at, 0
            while end < len(runs) and (end == at or rows + len(runs[end]) // 4 <= ROWS):
                rows += len(runs[end]) // 4
                end += 1
            part = runs[at:end]
            sizes = np.array([len(r) // 4 for r in part])
            ids = pa.table({"run": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": np.arange(sizes.sum(), dtype=np.int32), "tok": np.frombuffer(b"".join(part), "<u4").astype(np.int32)})
            self.con.register("ids", ids)
            got = self.con.execute(DECODE).fetchall()
            self.con.unregister("ids")
            named = {run: bytes.fromhex(h) for run, h in got}
            out += [named.get(i, b"") for i in range(len(part))]
            at = end
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_runs([np.array(ids, "<u4").tobytes()])[0]


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Sent:
    def __init__(self, spark: SparkSession, raw: bytes, pattern: str):
        self.sent, self.pattern = spark.sparkContext.broadcast(raw), pattern
        self.key = hashlib.sha256(raw + pattern.encode()).hexdigest()

    def codec(self) -> Codec:
        codecs = worker_state("byte_bpe")
        if self.key not in codecs:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, self.sent.value.splitlines()))}
            codecs[self.key] = Codec(ranks, self.pattern)
        return codecs[self.key]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, SHA-256 of its ids (little-endian 32-bit) and of the bytes decoded from them."""
    sent = _Sent(docs.sparkSession, load_ranks(vocabulary), pattern)
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()

    def digests(codec: Codec, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        if len(texts) == 1:  # perhaps a very long one
            n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
            for part in codec.encode_runs(texts[0]):
                n += len(part) // 4
                ids.update(part)
                raw.update(codec.decode_runs([part])[0])
            yield n, ids.hexdigest(), raw.hexdigest()
            return
        encoded = codec.encode_pieces([codec.pattern.findall(t) for t in texts])
        for ids, raw in zip(encoded, codec.decode_runs(encoded)):
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.codec()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                for t in batch.column(1).slice(at, 2000):
                    text = t.as_py() or ""
                    if texts and chars + len(text) > GROUP:
                        break
                    texts.append(text)
                    chars += len(text)
                n, ids, raw = zip(*digests(codec, texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return rows.mapInArrow(run, f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """The documents with the array of ids of ``text_col`` in a column ``to``."""
    from pyspark.sql.functions import arrow_udf

    sent = _Sent(docs.sparkSession, load_ranks(vocabulary), pattern)

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = sent.codec()
        return pa.array([codec.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return with_column(docs, text_col, to, ids)


def decode(rows: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """The rows with the bytes that ``ids_col`` stands for in a column ``to``; null for null."""
    from pyspark.sql.functions import arrow_udf

    sent = _Sent(rows.sparkSession, load_ranks(vocabulary), pattern)

    @arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        runs = [None if x is None else np.array(x, "<u4").tobytes() for x in lists.to_pylist()]
        done = iter(sent.codec().decode_runs([r for r in runs if r is not None]))
        return pa.array([None if r is None else next(done) for r in runs], pa.binary())

    return with_column(rows, ids_col, to, raw)
