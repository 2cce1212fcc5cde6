"""SimHash near-duplicates with vantage-point trees.

Fingerprints: a document's 64 bits are the majorities over the XXH64 values (seed 42) of its word shingles.

Exact pairs within ``radius`` differing bits: by the pigeonhole principle two such fingerprints agree in one of
``radius + 1`` blocks of bits. For each block a vantage-point tree partitions all fingerprints by their Hamming
distance to vantage points; inside a block the radius is 0, so the triangle bound leaves one branch, and nothing
is copied. A leaf whose block values do not tell its fingerprints apart is divided further by the distance over
all 64 bits; there the bound leaves both branches near the border, and a fingerprint is also sent, as a query, to
the shards that its ball overlaps. Trees are built from a bounded sample of distinct fingerprints; the sample
only balances the shards, every fingerprint goes through them and no pair is lost whatever the sample. Inside a
shard a local vantage-point tree over all bits prunes by the same bound.

Equal fingerprints are merged first (pre-aggregated before the shuffle). A shard reports a spanning forest of its
links, never all pairs. Components are found by repeated minimum and pointer jumping over written tables, so
neither links nor components meet in one place and lost executors only cost their own tasks.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer words than a
shingle is one shingle; repeated rows with equal ids fall together; null ids are kept, with a null component
unless another document of the group has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import join_hot, materialise, pick, worker_state

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that a shard is meant to hold; most shards of a tree, which bounds what is sent; sample rows: a shard, least.
SHARD, SHARDS, PER_SHARD, SAMPLE = 4096, 50_000, 4, 8192
_LEAF = 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))), np.uint64, len(words) - size + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``fp`` (the 64 bits as a signed long). One scan, no shuffle."""
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"{id_col} {id_type}, fp bigint")


class Node:
    """Inner: vantage point, mask, radius of queries, threshold, branches. Leaf: shard number."""

    __slots__ = ("vantage", "mask", "radius", "limit", "near", "far", "shard")

    def __init__(self):
        self.near = None


def _block_masks(radius: int) -> list[int]:
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def distances(fps: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask))


def _split(sample: np.ndarray, mask: int, radius: int, rng) -> tuple | None:
    """The vantage point and threshold that divide the sample best, queries on the border counted on both sides."""
    best = None
    for v in rng.choice(sample, min(8, len(sample)), replace=False).tolist():
        d = distances(sample, v, mask)
        for limit in {int(np.median(d)), int(np.median(d)) - 1}:
            if limit < 0:
                continue
            near, far = int((d <= limit + radius).sum()), int((d > limit - radius).sum())
            if (d <= limit).any() and (d > limit).any() and max(near, far) < 0.9 * len(sample) and (best is None or max(near, far) < best[0]):
                best = (max(near, far), v, limit, d)
    return best


def build(sample: np.ndarray, mask: int, radius: int, per_leaf: int, shards: list[int], rng, whole: bool = False) -> Node:
    """A tree over one block; leaves that the block cannot divide are divided over all bits (not with a radius below 0)."""
    node = Node()
    if len(sample) > per_leaf:
        found = _split(sample, mask, 0, rng) if not whole else None
        used, r = mask, 0
        if found is None and radius >= 0:
            whole, used, r = True, (1 << BITS) - 1, radius
            found = _split(sample, used, r, rng)
        if found:
            _, node.vantage, node.limit, d = found
            node.mask, node.radius = used, r
            node.near = build(sample[d <= node.limit], mask, radius, per_leaf, shards, rng, whole)
            node.far = build(sample[d > node.limit], mask, radius, per_leaf, shards, rng, whole)
            return node
    node.shard = shards[0]
    shards[0] += 1
    return node


def route(node: Node, fps: np.ndarray, at: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places, whether at home) of all fingerprints, by the triangle bound."""
    if not len(at):
        return
    if node.near is None:
        yield node.shard, at, home
        return
    d = distances(fps[at], node.vantage, node.mask).astype(np.int64)
    inside = d <= node.limit
    near, far = d - node.radius <= node.limit, d + node.radius > node.limit
    yield from route(node.near, fps, at[near], home[near] & inside[near])
    yield from route(node.far, fps, at[far], home[far] & ~inside[far])


class Local:
    """A vantage-point tree over all bits in one shard, for exact searches."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius, self.rng = fps, radius, np.random.default_rng(0)
        self.root = self._build(np.arange(len(fps)))

    def _build(self, at: np.ndarray):
        if len(at) <= _LEAF * 4:
            return at
        found = _split(self.fps[at] if len(at) <= 2000 else self.fps[self.rng.choice(at, 2000, replace=False)], (1 << BITS) - 1, self.radius, self.rng)
        if not found:
            return at
        _, v, limit, _ = found
        d = distances(self.fps[at], v, (1 << BITS) - 1)
        return v, limit, self._build(at[d <= limit]), self._build(at[d > limit])

    def links(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query places, points) within the radius."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, tuple):
                v, limit, near, far = node
                d = distances(queries[at], v, (1 << BITS) - 1).astype(np.int64)
                stack.append((near, at[d - self.radius <= limit]))
                stack.append((far, at[d + self.radius > limit]))
                continue
            step = max(1, 2_000_000 // max(1, len(node)))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                q, p = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.fps[node][None, :]) <= self.radius)
                yield part[q], node[p]


def forest(fps: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of a shard: (place, place of its root)."""
    points = np.flatnonzero(home)
    if not len(points) or len(fps) < 2:
        return []
    parent = np.arange(len(fps))

    # the largest group near one point is linked to it at once; its members need not be compared with each other
    some = points[:: max(1, len(points) // 16)]
    near = np.bitwise_count(fps[some][:, None] ^ fps[None, :]) <= radius
    best = int(near.sum(axis=1).argmax())
    core = near[best]
    parent[core] = int(np.flatnonzero(core)[0])
    queries = np.flatnonzero(~core | ~home)
    for q, p in Local(fps[points], radius).links(fps[queries]):
        q, p = queries[q], points[p]
        apart = q != p
        q, p = q[apart], p[apart]
        while len(q):  # hook roots onto smaller roots, all links at once
            for _ in range(64):
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            a, b = parent[q], parent[p]
            open_ = a != b
            if not open_.any():
                break
            q, p, a, b = q[open_], p[open_], a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    for _ in range(64):
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    low = np.flatnonzero(parent != np.arange(len(fps)))
    return list(zip(low.tolist(), parent[low].tolist()))


def sample_size(n: int, shard: int = SHARD) -> int:
    """Rows that balance a tree over ``n``: some for each shard; above ``SHARDS`` shards of that size, shards grow instead."""
    return max(SAMPLE, PER_SHARD * min(SHARDS, -(-n // shard)))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (``a`` > ``b``, as signed longs) that connect all fingerprints within ``radius`` bits.

    ``distinct``: one row per fingerprint, column ``fp``.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    least = distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(sample_size(n, shard))
    got = np.array([r[0] for r in least.collect()], np.int64).view(np.uint64)
    per_leaf = max(1, int(shard * len(got) / max(n, 1)))
    rng, count, trees = np.random.default_rng(7), [0], []
    for mask in _block_masks(radius):
        trees.append(build(got, mask, radius, per_leaf, count, rng))
    sent = spark.sparkContext.broadcast(trees)  # of at most ``PER_SHARD * SHARDS`` leaves a tree

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            every, here = np.arange(len(fps)), np.ones(len(fps), bool)
            found = [x for tree in sent.value for x in route(tree, fps, every, here)]
            if found:
                at = np.concatenate([a for _, a, _ in found])
                numbers = np.repeat(np.array([n for n, _, _ in found], np.int32), [len(a) for _, a, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(fps[at].view(np.int64)), pa.array(np.concatenate([h for _, _, h in found]))], names=["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(fps.view(np.int64), kind="stable")
        fps, home = fps[order], home[order]
        pairs = forest(fps, home, radius)
        signed = fps.view(np.int64)
        return pa.table({"a": pa.array([int(signed[x]) for x, _ in pairs], pa.int64()), "b": pa.array([int(signed[y]) for _, y in pairs], pa.int64())})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest fingerprint reachable: (``fp``, ``root``) for every end of a link.

    Each round takes a vertex to the least label around it and then to that label's label; tables are written
    each round, so lineage stays short.
    """
    edges = materialise(links.union(links.select("b", "a")), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        seen = edges.join(labels.select(F.col("fp").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("fp")).agg(F.min("r").alias("r"))
        best = labels.join(seen, "fp", "left").select("fp", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        # hooking: what a root learns from any of its members
        hooks = best.groupBy(F.col("old").alias("fp")).agg(F.min("root").alias("h"))
        best = best.join(hooks, "fp", "left").select("fp", "old", F.least("root", F.coalesce("h", "root")).alias("root"))
        jump = best.select(F.col("fp").alias("root"), F.col("root").alias("up"))
        best = materialise(best.join(jump, "root", "left").select("fp", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        labels = best.select("fp", "root")
        if best.where(F.col("old") != F.col("root")).limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``fp``, ``component_id`` (smallest id reachable over links, itself included)."""
    prints = materialise(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct")
    labels = components(fingerprint_links(distinct.select("fp"), radius))
    linked = materialise(distinct.select("fp", "least").join(labels, "fp"), "linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = join_hot(linked, roots, ["root"], ["fp"]).select("fp", "component_id")
    by_print = distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_hot(prints, by_print, ["fp"], [id_col], distinct.select("fp", "n")).select(id_col, "fp", "component_id")


#: Whole documents: sets of five-word shingles are near duplicates at a Jaccard similarity of ``WIDE_SIMILARITY`` or more.
WIDE_SHINGLE, WIDE_SIMILARITY = 5, 0.8
#: Candidates: fingerprints of 640 bits that agree in one of some blocks of bits and differ in at most 64 of the first 256.
#: Each bit of two large sets at 0.8 differs with a chance of 0.1515: 39 of 256 bits (deviation 5.7). The worst are sets of
#: 4 and 5 shingles: 0.1875 a bit, 48 bits (deviation 6.2). Strangers differ in 128.
WIDE_WORDS, WIDE_COMPARED, WIDE_RADIUS, WIDE_APART = 10, 4, 64, 0.1515
#: Bits of a block at least; documents that its values are meant to hold; chance that two large sets at 0.8 agree in none.
WIDE_BLOCK, WIDE_BUCKET, WIDE_MISS = 12, 4096, 0.0005


def wide_blocks(n: int) -> list[np.ndarray]:
    """Places of the bits of each block, for ``n`` documents: blocks as wide as it takes for values to hold so many
    documents, and as many as it takes for the chance of a miss: 51 of 12 bits up to 16 million, 102 of 16 for 250 million.
    """
    width = max(WIDE_BLOCK, int(np.ceil(np.log2(max(n, 1) / WIDE_BUCKET))))
    count = int(np.ceil(np.log(WIDE_MISS) / np.log(1 - (1 - WIDE_APART) ** width)))
    rng = np.random.default_rng(width)
    return [np.sort(rng.choice(64 * WIDE_WORDS, width, replace=False)) for _ in range(count)]


def block_values(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of one block of each fingerprint, as a number."""
    out = np.zeros(len(fps), np.uint64)
    for at in bits.tolist():
        out = (out << np.uint64(1)) | ((fps[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1))
    return out


def shingle_set(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """The set of a text's word shingles, as sorted hashes; a text of fewer words is one shingle, none without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def wide_fingerprint(hashes: np.ndarray, words_: int = WIDE_WORDS) -> np.ndarray:
    """Majority bits over hashes of 64 * ``words_`` bits of a set of shingles; zero for an empty set."""
    if not len(hashes):
        return np.zeros(words_, np.uint64)
    counts = np.zeros(64 * words_, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384]
        with np.errstate(over="ignore"):
            wide = np.stack([_spread(part + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64))) for i in range(words_)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all rows within ``radius`` bits: to the row of some that is near most, else each to each."""
    near = lambda rows, others: np.bitwise_count(fps[rows][:, None, :] ^ fps[others][None, :, :]).sum(axis=2, dtype=np.int32) <= radius
    every = np.arange(len(fps))
    some = every[:: max(1, len(fps) // 8)]
    found = near(some, every)
    best = int(found.sum(axis=1).argmax())
    hub, core = int(some[best]), found[best]
    out = [(int(i), hub) for i in np.flatnonzero(core) if i != hub]
    rest, step = np.flatnonzero(~core), max(1, 400_000 // len(fps))
    for at in range(0, len(rest), step):
        rows = rest[at : at + step]
        q, p = np.nonzero(near(rows, every))
        q = rows[q]
        # a link to a row near the hub is one of many to the same component: one for each is enough
        inside = core[p]
        first, where = np.unique(q[inside], return_index=True)
        out += list(zip(first.tolist(), p[inside][where].tolist()))
        apart = ~inside & (p < q)
        out += list(zip(q[apart].tolist(), p[apart].tolist()))
    return out


def _compress(pairs: list[tuple[int, int]], names: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links, as stars on the least name: (name, least name of its tree)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(int(names[a])), find(int(names[b]))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root) for x in list(parent) if (root := find(x)) != x]


def set_links(sets: list[np.ndarray], similarity: float = WIDE_SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect all sets of exactly this Jaccard similarity or more.

    One set (the hub) is compared with all. Jaccard distance obeys the triangle bound: a set linked to the hub can only be
    linked to another set that is not, if that one is within twice the distance of the hub. Those are hubs later, so the
    linked ones need not be.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out, pending, must = [], np.ones(len(sets), bool), np.zeros(len(sets), bool)
    while pending.any():
        hub = int(np.flatnonzero(pending)[0])
        common = np.bincount(owner[np.isin(every, sets[hub])], minlength=len(sets))
        union = sizes + sizes[hub] - common
        linked = common >= similarity * union - 1e-9 * union  # two empty sets are linked
        out += [(int(i), hub) for i in np.flatnonzero(linked) if i != hub]
        must |= ~linked & (common >= (2 * similarity - 1 - 1e-9) * union)
        pending &= ~linked | must
        pending[hub] = must[hub] = False
    return out


#: Sets that one task compares with each other; of a larger component, parts of about so many meet two at a time.
PART = 1000


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]


def _similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of a set with others; two empty sets are equal."""
    sizes = np.array([len(x) for x in others], np.int64)
    inside = np.isin(np.concatenate(others), one)
    common = np.bincount(np.repeat(np.arange(len(others)), sizes)[inside], minlength=len(others))
    union = sizes + len(one) - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _links(pairs: list[tuple[int, int]], ids: np.ndarray) -> pa.Table:
    links = _compress(pairs, ids)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def exact_links(sets: DataFrame, sizes: DataFrame, similarity: float = WIDE_SIMILARITY, part: int = PART) -> DataFrame:
    """Links (``a`` > ``b``) that connect all sets of a component of this Jaccard similarity or more.

    ``sets``: id, hashes, root (the least id of the component) and ``n``, the component's size; ``sizes``: root, n. A
    component of up to ``part`` sets is compared in one task. In a larger one all sets are compared with the root's, part
    by part; those that it links need not be compared with each other. The others are then compared with all, two parts
    in a task; by the triangle bound of the Jaccard distance, one that is further from the root than twice the distance
    of links cannot be linked to a set that the root links.
    """
    edge, far = 1e-9, 2 * similarity - 1 - 1e-9

    def whole(table: pa.Table) -> pa.Table:
        return _links(set_links(_sets(table), similarity), table.column("id").to_numpy())

    small = sets.where(F.col("n") <= part).select("id", "hashes", "root").groupBy("root").applyInArrow(whole, "a long, b long")
    if not sizes.where(F.col("n") > part).limit(1).count():
        return small
    parts = lambda n: F.ceil(F.col(n) / part).cast("int")
    large = materialise(sets.where(F.col("n") > part).withColumn("part", F.pmod(F.xxhash64("id"), parts("n")).cast("int")), "wide-large")
    first = large.where("id = root").dropDuplicates(["root"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts("n") - 1)))
    both = large.withColumn("hub", F.lit(False)).unionByName(first.withColumn("hub", F.lit(True)))

    def meet(table: pa.Table) -> pa.Table:
        hub = table.column("hub").to_numpy(zero_copy_only=False).astype(bool)
        mine = table.filter(pa.array(~hub))
        near = _similar(_sets(table.filter(pa.array(hub)))[0], _sets(mine)) if mine.num_rows else np.zeros(0)
        state = np.where(near >= similarity - edge, 2, np.where(near >= far, 1, 0)).astype(np.int32)
        return mine.select(["id", "hashes", "root", "part"]).append_column("state", pa.array(state))

    told = materialise(both.groupBy("root", "part").applyInArrow(meet, "id long, hashes binary, root long, part int, state int"), "wide-told")
    by_root = told.where("state = 2 AND id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    open_ = materialise(told.where("state < 2").groupBy("root").agg(F.count("*").alias("m")), "wide-open")
    members = join_hot(told, open_, ["root"], ["id"]).withColumn("of", F.explode(F.sequence(F.lit(0), parts("m") - 1)))
    counts = sizes.where(F.col("n") > part).join(open_, "root")
    asked = join_hot(told.where("state < 2").drop("part"), counts, ["root"], ["id"], open_.select("root", F.col("m").alias("n")))
    asked = asked.withColumn("of", F.pmod(F.xxhash64("id", F.lit(1)), parts("m")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts("n") - 1)))
    columns = ["root", "part", "of", "id", "hashes", "state"]
    cells = members.select(*columns, F.lit(False).alias("asks")).unionByName(asked.select(*columns, F.lit(True).alias("asks")))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, state, every = table.column("id").to_numpy(), table.column("state").to_numpy(), _sets(table)
        pairs: list[tuple[int, int]] = []
        for q in np.flatnonzero(asks):
            others = np.flatnonzero(~asks & ((state < 2) | (state[q] == 1)))
            if len(others):
                near = _similar(every[q], [every[i] for i in others]) >= similarity - edge
                pairs += [(int(q), int(i)) for i in others[near] if ids[i] != ids[q]]
        return _links(pairs, ids)

    rest = cells.groupBy("root", "part", "of").applyInArrow(compare, "a long, b long")
    return small.unionByName(by_root).unionByName(rest)


def similar_documents(docs: DataFrame, similarity: float = WIDE_SIMILARITY, size: int = WIDE_SHINGLE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with an id: id, and ``component_id``, the smallest id among its near duplicates and their near duplicates.

    A vantage-point tree for each block of bits deals the fingerprints to shards (inside a block the radius is 0, so
    nothing is copied within a tree); in a shard, fingerprints of equal block values are compared. Of the documents that
    such candidate links connect, the sets of shingles are compared (``exact_links``): only exact links count. Equal
    fingerprints with equal sets are merged before.
    """
    rows = pick(docs, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = [f"f{i}" for i in range(WIDE_WORDS)]
    compared = parts[:WIDE_COMPARED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            fps, digests = np.zeros((batch.num_rows, WIDE_WORDS), np.uint64), []
            for i, t in enumerate(batch.column(1)):
                hashes = shingle_set(t.as_py(), size)
                fps[i] = wide_fingerprint(hashes)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(WIDE_WORDS))], names=["id", "digest", *parts])

    prints = materialise(rows.mapInArrow(run, "id long, digest binary, " + ", ".join(f"{p} long" for p in parts)), "wide")
    distinct = materialise(prints.groupBy("digest", *parts).agg(F.min("id").alias("least"), F.count("*").alias("n")), "wide-distinct")
    spark, n = docs.sparkSession, distinct.count()
    least = distinct.select(*parts).orderBy(F.xxhash64(*parts), *parts).limit(sample_size(n, shard)).collect()
    got = np.array([tuple(r) for r in least], np.int64).reshape(-1, WIDE_WORDS).view(np.uint64)
    blocks = wide_blocks(n)
    per_leaf, rng, count, every_bit = max(1, int(shard * len(got) / max(n, 1))), np.random.default_rng(7), [0], (1 << len(blocks[0])) - 1
    trees = [build(block_values(got, bits), every_bit, -1, per_leaf, count, rng) for bits in blocks]
    sent = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            fps = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(WIDE_WORDS)], axis=1).view(np.uint64)
            every, here = np.arange(len(fps)), np.ones(len(fps), bool)
            found = []
            for tree, bits in zip(sent.value, blocks):
                value = block_values(fps, bits)
                found += [(number, at, value[at].view(np.int64)) for number, at, _ in route(tree, value, every, here)]
            if found:
                kept = batch.select([*compared, "least"]).take(pa.array(np.concatenate([at for _, at, _ in found])))
                numbers = np.repeat(np.array([x for x, _, _ in found], np.int32), [len(at) for _, at, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([v for _, _, v in found])), *kept.columns], names=["shard", "value", *compared, "least"])

    def search(table: pa.Table) -> pa.Table:
        fps = np.stack([table.column(p).to_numpy() for p in compared], axis=1).view(np.uint64)
        ids, value = table.column("least").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.diff(value[order])) + 1
        pairs: list[tuple[int, int]] = []
        for bucket in np.split(order, edges):
            if len(bucket) > 1:
                pairs += [(int(bucket[a]), int(bucket[b])) for a, b in bucket_links(fps[bucket], WIDE_RADIUS)]
        links = _compress(pairs, ids)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], names=["id", "hashes", "root", "n"])

    dealt = distinct.select(*parts, "least").mapInArrow(deal, "shard int, value long, " + ", ".join(f"{p} long" for p in compared) + ", least long")
    candidates = components(materialise(dealt.groupBy("shard").applyInArrow(search, "a long, b long").distinct(), "wide-candidates")).select(F.col("fp").alias("id"), "root")
    sizes = materialise(candidates.groupBy("root").agg(F.count("*").alias("n")), "wide-sizes")
    sized = join_hot(candidates, sizes, ["root"], ["id"], sizes)
    sets = rows.join(sized, "id").select("id", "text", "root", "n").mapInArrow(gather, "id long, hashes binary, root long, n long").dropDuplicates(["id", "hashes"])
    labels = components(materialise(exact_links(sets, sizes, similarity), "wide-links"))
    roots = distinct.join(labels.select(F.col("fp").alias("least"), "root"), "least", "left").select("digest", F.coalesce("root", "least").alias("component_id"))
    return join_hot(prints, roots, ["digest"], ["id"], distinct.select("digest", "n")).select(F.col("id").alias(id_col), "component_id")


def keep_first(docs: DataFrame, similarity: float = WIDE_SIMILARITY, size: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, with all its columns.

    Rows without an id stay, as they cannot be named; rows that repeat the smallest id all stay.
    """
    ids = similar_documents(docs, similarity, size, id_col=id_col, text_col=text_col)
    names = list(docs.columns)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    gone = ids.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct()
    return inner.join(gone, inner[f"c{names.index(id_col)}"] == gone["gone_id"], "left_anti").toDF(*names)
