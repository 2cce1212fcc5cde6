"""Benchmark decontamination with generalised suffix automata.

The words of all test items go into generalised suffix automata. Training words are streamed through them;
the longest match that ends at each word is tracked. A match of ``window`` words or more, or of a whole item
that is shorter, marks its words as hit. Spans that are too long or cover too much are cut out.

The automata are built in tasks, one of each block of about ``BLOCK_WORDS`` item words, and written as sorted arrays
of some 50 bytes a word. Blocks of ``GROUP_BYTES`` together are broadcast at a time, and all documents meet all
blocks of the group in one scan without a shuffle; where there are more items than one group holds, the documents
are scanned once a group, and hits are carried along. So neither what is sent nor what a worker holds grows with the
item table, and no automaton is built twice. Words that occur in no item of a block reset its automaton, so only runs
of known words are streamed, all runs of a batch at a time: as a hit depends on the last ``window`` words only, a long
run is cut into pieces that begin ``window`` - 1 words early.

Defined results: null or empty texts have no words and no hits; items without words are ignored; an item without an
id marks words but is not named; items are named by their ids as strings, each once, so items that repeat an id count
as one; equal items are all reported; repeated document rows are each judged alone; empty tables give empty results
(no items: nothing is hit).
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import materialise, pick, small_batches, word_bytes, worker_state

WINDOW = 10
#: Item words in one automaton, and bytes of the automata that are sent together.
BLOCK_WORDS, GROUP_BYTES = 200_000, 64 << 20
#: Hit spans of more than so many words are cut. A hit spans a whole window or a whole item, so 0 cuts every hit.
MAX_SPAN = 0
#: Documents with more than this share of their words in hits go.
MAX_COVERAGE = 0.5
#: Words of the pieces in which runs are streamed.
PIECE = 128


class _Builder:
    """A generalised suffix automaton in the making: transitions, suffix links and lengths by state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, transitions: dict[int, int], link: int, length: int) -> int:
        self.next.append(transitions), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the strings of up to one word more than ``p``'s."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, word_ids: list[int]) -> None:
        last = 0
        for c in word_ids:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            p, last = last, self._state({}, 0, self.length[last] + 1)
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)


class Automaton:
    """A generalised suffix automaton over the words of items, as arrays, and the items of each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        rows = [(name, words) for name, words in items if words]
        vocabulary: dict[bytes, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in rows]
        self.window, self.words, self.names = window, list(vocabulary), [None if name is None else str(name) for name, _ in rows]
        built = _Builder()
        for word_ids in coded:
            built.add(word_ids.tolist())
        keys = np.array([s << 32 | c for s, to in enumerate(built.next) for c in to], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([t for to in built.next for t in to.values()], np.int32)[order]
        self.link, self.length = np.maximum(np.array(built.link, np.int32), 0), np.array(built.length, np.int32)
        # the items by the state of their windows, or of themselves if they are shorter
        sizes = np.array([min(window, len(x)) for x in coded], np.int64)
        self.shortest = int(sizes.min()) if len(sizes) else window
        found, self.whole = [], np.zeros(len(self.link), bool)
        if len(rows):
            starts, ends = np.cumsum([0] + [len(x) for x in coded[:-1]]), np.cumsum([len(x) for x in coded])
            owner = np.repeat(np.arange(len(coded)), [len(x) for x in coded])
            for at, state, matched in self.stream(np.concatenate(coded), starts, ends):
                size = sizes[owner[at]]
                full = matched >= size
                found.append(np.stack([self.trimmed(state[full], size[full]), owner[at][full]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            self.whole[pairs[sizes[pairs[:, 1]] < window, 0]] = True
            self.named, self.items = pairs[:, 0], pairs[:, 1].astype(np.int32)
        else:
            self.named, self.items = np.zeros(0, np.int64), np.zeros(0, np.int32)
        # the longest whole short item that is a suffix of a state's strings: the state itself, or one up its links
        self.short = np.where(self.whole, np.arange(len(self.link), dtype=np.int32), 0)
        for state in np.argsort(self.length, kind="stable")[1:].tolist():
            if not self.short[state]:
                self.short[state] = self.short[self.link[state]]

    def trimmed(self, state: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The states of the last ``size`` words of matches."""
        state = state.copy()
        while (longer := self.length[self.link[state]] >= size).any():
            state[longer] = self.link[state[longer]]
        return state

    def stream(self, word_ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place, state and longest matching length for a word of each run [start, end) at a time."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those that go on are the first ones
        at, left = starts[order].copy(), (ends - starts)[order]
        state, matched = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, "left"))
            at, state, matched, left = at[:n], state[:n], matched[:n], left[:n]
            word, open_ = word_ids[at], np.arange(n)
            while len(open_):
                key = state[open_] << 32 | word[open_]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[place] == key
                on = open_[there]
                state[on], matched[on] = self.to[place[there]], matched[on] + 1
                back = open_[~there]
                lost = state[back] == 0
                matched[back[lost]] = 0
                open_ = back[~lost]
                state[open_] = self.link[state[open_]]
                matched[open_] = self.length[state[open_]]
            yield at, state, matched
            at = at + 1

    def hits(self, word_ids: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks of hit words; and pairs (text, item) that were found.

        ``word_ids``: of the words of all texts, -1 for a word of no item; ``texts``: the text of each word.
        """
        window, marks = self.window, np.zeros(len(word_ids) + 1, np.int64)
        known = word_ids >= 0
        joined = known[1:] & known[:-1] & (texts[1:] == texts[:-1])
        begins, ends = np.flatnonzero(known & ~np.concatenate(([False], joined))), np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        some = ends - begins >= self.shortest
        begins, ends = begins[some], ends[some]
        pieces = np.maximum(1, -(-(ends - begins) // PIECE))
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(begins, pieces) + within * PIECE
        early = np.maximum(np.repeat(begins, pieces), first - (window - 1))
        found = []
        for at, state, matched in self.stream(word_ids, early, np.minimum(first + PIECE, np.repeat(ends, pieces))):
            full = matched >= window
            if full.any():
                marks[at[full] + 1 - window] += 1
                marks[at[full] + 1] -= 1
                found.append(np.stack([texts[at[full]], self.trimmed(state[full], window)], axis=1))
            item = self.short[state]
            item = np.where(self.length[item] <= matched, item, self.short[self.link[state]])
            while (there := np.flatnonzero(item)).size:
                at, item = at[there], item[there]
                marks[at + 1 - self.length[item]] += 1
                marks[at + 1] -= 1
                found.append(np.stack([texts[at], item], axis=1))
                item = self.short[self.link[item]]
        if not found:
            return marks[:-1] > 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        low, high = np.searchsorted(self.named, pairs[:, 1], "left"), np.searchsorted(self.named, pairs[:, 1], "right")
        n = high - low
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.cumsum(marks)[:-1] > 0, np.repeat(pairs[:, 0], n), self.items[which]

    def size(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.to, self.link, self.length, self.named, self.items, self.whole, self.short)) + 120 * len(self.words)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The automata of the items, pickled: ``size`` in a worker's memory, and ``automaton``; one task for each block or so.

    An item longer than a block goes into several, which share ``window`` - 1 words: no window is lost.
    """
    rows = pick(benchmark, id_col, text_col).toDF("id", "text").where(F.col("text").isNotNull()).select(F.col("id").cast("string"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("decontaminate.build")
        block: list[tuple[object, list[bytes]]] = []
        n = 0

        def done() -> pa.RecordBatch:
            built = Automaton(block, window)
            return pa.RecordBatch.from_arrays([pa.array([built.size()], pa.int64()), pa.array([pickle.dumps(built)], pa.binary())], names=["size", "automaton"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_bytes(text.as_py())
                for at in range(0, len(words) - window + 1, max(1, block_words - window + 1)) if len(words) > block_words else [0] * bool(words):
                    part = words[at : at + block_words]
                    if block and n + len(part) > block_words:
                        yield done()
                        block, n = [], 0
                    block.append((name, part))
                    n += len(part)
        if block:
            yield done()

    return materialise(rows.repartition(max(1, chars // (6 * block_words))).mapInArrow(run, "size bigint, automaton binary"), "automata")


def grouped(built: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """The pickled automata, as many at a time as ``group_bytes`` hold (one at least)."""
    group, total = [], 0
    for row in built.toLocalIterator():
        if group and total + row["size"] > group_bytes:
            yield group
            group, total = [], 0
        group.append(bytes(row["automaton"]))
        total += row["size"]
    yield group


class _Group:
    """Automata that a worker holds together, with one look-up of words for all."""

    def __init__(self, pickled: list[bytes]):
        self.automata = [pickle.loads(x) for x in pickled]
        self.words: dict[bytes, int] = {}
        self.places = []
        for a in self.automata:
            self.places.append(np.array([self.words.setdefault(w, len(self.words)) for w in a.words], np.int64))
        for k, places in enumerate(self.places):  # from the group's words to the automaton's
            own = np.full(len(self.words) + 1, -1, np.int64)
            own[places] = np.arange(len(places))
            self.places[k] = own
        self.shortest = min((a.shortest for a in self.automata), default=0)

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """Words, hit places and items found of each text."""
        get, words = self.words.get, [word_bytes(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        out = [(n, np.zeros(0, np.int64), set()) for n in sizes.tolist()]
        if not self.automata or not sizes.sum():
            return out
        ids = np.fromiter((get(w, -1) for text in words for w in text), np.int64, int(sizes.sum()))
        owner, marks = np.repeat(np.arange(len(texts)), sizes), np.zeros(len(ids), bool)
        for a, places in zip(self.automata, self.places):
            hit, text, item = a.hits(places[ids], owner)
            marks |= hit
            for t, i in zip(text.tolist(), item.tolist()):
                if a.names[i] is not None:
                    out[t][2].add(a.names[i])
        for t in np.unique(owner[marks]).tolist():
            out[t] = (out[t][0], np.flatnonzero(marks[starts[t] : starts[t] + sizes[t]]), out[t][2])
        return out


def spans(hit: np.ndarray | list[int]) -> list[tuple[int, int]]:
    """Maximal runs of hit words, as [start, end)."""
    hit = np.asarray(hit, np.int64)
    if not len(hit):
        return []
    cuts = np.flatnonzero(np.diff(hit) > 1)
    return list(zip(hit[np.concatenate(([0], cuts + 1))].tolist(), (hit[np.concatenate((cuts, [len(hit) - 1]))] + 1).tolist()))


def scanned(
    rows: DataFrame, text_col: str, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, finish: Callable[[str, np.ndarray, int], str | None] | None = None
) -> DataFrame:
    """``rows`` with ``n_words_``, ``longest_`` (words of the longest hit span), ``hit_`` (places of hit words) and
    ``items_`` (names found), a group of automata at a time.

    ``finish``: from a text, its hit places and number of words to the text that is left; called once, for texts with hits.
    """
    small_batches(rows.sparkSession)
    sc = rows.sparkSession.sparkContext
    at, groups, found = rows.columns.index(text_col), grouped(blocks(benchmark, window), group_bytes), None
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", n_words_ bigint, longest_ bigint, hit_ array<int>, items_ array<string>"
    group = next(groups, None)
    while group is not None:
        if found is not None:
            rows = materialise(found, "scanned")
        sent, key, more, after = sc.broadcast(group), uuid.uuid4().hex, found is not None, next(groups, None)
        change = finish if after is None else None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key, more=more, change=change) -> Iterator[pa.RecordBatch]:
            state = worker_state("decontaminate." + key)
            if "group" not in state:
                state["group"] = _Group(sent.value)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                got = state["group"].scan(texts)
                hit, items, columns = [x for _, x, _ in got], [x for _, _, x in got], batch.columns
                if more:
                    hit = [np.union1d(x, y) for x, y in zip(hit, columns[-2].to_pylist())]
                    items = [x.union(y) for x, y in zip(items, columns[-1].to_pylist())]
                    columns = columns[:-4]
                if change and any(map(len, hit)):
                    columns[at] = pa.array([change(t, h, n) if len(h) else t for t, h, (n, _, _) in zip(texts, hit, got)], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in hit]), pa.int32()), pa.array(np.concatenate([*hit, np.zeros(0)]).astype(np.int32)))
                longest = [max((b - a for a, b in spans(x)), default=0) for x in hit]
                names = [f.name for f in batch.schema][: len(columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _, _ in got], pa.int64()), pa.array(longest, pa.int64()), lists, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*names, "n_words_", "longest_", "hit_", "items_"])

        found, group = rows.mapInArrow(run, kinds), after
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, item_ids (sorted as strings), longest_span, contaminated."""
    found = scanned(pick(docs, id_col, text_col).toDF("id_", "text_"), "text_", benchmark, window, group_bytes)
    return found.select(
        F.col("id_").alias(id_col), F.col("n_words_").alias("n_words"), F.size("hit_").cast("long").alias("n_hit"), F.col("items_").alias("item_ids"),
        F.col("longest_").alias("longest_span"), (F.size("hit_") > 0).alias("contaminated"),
    )


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text: str, hit: np.ndarray | list[int], n_words: int, max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE) -> str | None:
    """``text`` without the hit spans of more than ``max_span`` words; None if hits cover over ``max_coverage`` of its words.

    The text between the first and the last word of a span goes; all else stays as it is.
    """
    if len(hit) > max_coverage * n_words:
        return None
    long = [(a, b) for a, b in spans(hit) if b - a > max_span]
    if not long:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in long:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE, text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents with contaminated spans cut out of ``text_col``; those covered over the limit go. All columns stay."""
    names = list(docs.columns)
    text = f"c{names.index(text_col)}"
    found = scanned(docs.toDF(*(f"c{i}" for i in range(len(names)))), text, benchmark, window, group_bytes, lambda t, hit, n: cut(t, hit, n, max_span, max_coverage))
    return found.where((F.size("hit_") == 0) | F.col(text).isNotNull()).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
