"""Sections, sentence scores, sentiment, dilution and embedding distances of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.scalars import ratio
from paritas.functions.texts import is_header, word_count

PREAMBLE = "PREAMBLE"
#: The questions, and example sentences that anchor each.
QUESTIONS = ("poverty", "refugee", "major_illness", "academic_career")
EXEMPLARS = {
    "poverty": ["I grew up in poverty.", "My family struggled financially throughout my childhood.", "I experienced economic hardship and food insecurity.", "We could not afford basic necessities."],
    "refugee": ["I came to this country as a refugee.", "My family fled persecution in our home country.", "We were displaced and resettled as refugees.", "I am the child of refugees."],
    "major_illness": ["I experienced a serious illness.", "I was diagnosed with a major medical condition.", "I underwent significant medical treatment.", "Illness shaped my path to medicine."],
    "academic_career": [
        "I plan to pursue an academic career in medicine.", "My goal is to become a physician-scientist.",
        "I am committed to a career in academic medicine and research.", "I want to work as a faculty member at an academic medical center.",
    ],
}
#: Sentences count from this similarity on; sharpness of their assignment; power of the sums.
THRESHOLD, SHARPNESS, POWER = 0.35, 8.0, 2.0


def exemplars(override: dict | None = None) -> dict:
    return {**EXEMPLARS, **(override or {})}


def sections(df: DataFrame, key: str, text: str, pattern: str | None = None) -> DataFrame:
    """Rows (key, pos, label, body, word_count) of the sections of each text, in order.

    A header starts a section; text before the first is PREAMBLE; sections without a body are dropped. All within a
    row: no shuffle, whatever the length of a document.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda s: F.struct(s.alias("raw"), F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).alias("line")))
    heads = F.filter(F.transform(F.col("l_"), lambda x, i: F.when(is_header(x["line"], pattern), i)), lambda i: i.isNotNull())
    rows = df.withColumn("l_", lines).withColumn("h_", F.concat(F.array(F.lit(-1)), heads))
    rows = rows.select(key, "l_", "h_", F.posexplode("h_").alias("i_", "at_"))
    stop = F.coalesce(F.get("h_", F.col("i_") + 1), F.size("l_"))
    body = F.array_join(F.transform(F.slice("l_", F.col("at_") + 2, stop - F.col("at_") - 1), lambda x: x["raw"]), "\n")
    label = F.when(F.col("at_") < 0, PREAMBLE).otherwise(F.get("l_", F.greatest(F.col("at_"), F.lit(0)))["line"])
    rows = rows.select(key, "i_", label.alias("label"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("body")).where("body <> ''")
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("i_")).alias("pos"), "label", "body", word_count(F.col("body")).alias("word_count"))


def rank_lowest(scores: DataFrame, key: str, instruments: int | None = None) -> DataFrame:
    """Per document and instrument the section of least score (the first one on ties), and whether all instruments agree.

    ``scores``: rows (key, pos, label, instrument, score) of scored sections. ``instruments``: how many were asked.
    """
    low = scores.groupBy(key, "instrument").agg(F.min_by("label", F.struct("score", "pos")).alias("lowest"))
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    same = F.size(F.collect_set("lowest").over(w)) == 1
    return low.withColumn("unanimous", (n >= 2) & same & (F.lit(True) if instruments is None else n == instruments))


def extractor_scores(sentences: DataFrame, questions: DataFrame, key: str = "doc_id", sent: str = "sent_no", vec: str = "vec", threshold: float = THRESHOLD, sharpness: float = SHARPNESS, power: float = POWER) -> DataFrame:
    """Per document and question the score of its sentences, and ``_total``.

    ``questions``: a few rows (question, vec). A sentence counts if its best similarity reaches the threshold; it is
    shared among the questions by a softmax, and its weighted similarities are summed and raised to ``power``.
    """
    pairs = sentences.crossJoin(F.broadcast(questions.select("question", F.col("vec").alias("q_"))))
    dot = F.aggregate(F.zip_with(F.col(vec), F.col("q_"), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    pairs = pairs.select(key, sent, "question", dot.alias("s"))
    w = Window.partitionBy(key, sent)
    pairs = pairs.withColumn("best", F.max("s").over(w)).withColumn("e", F.exp(F.lit(sharpness) * (F.col("s") - F.col("best"))))
    pairs = pairs.withColumn("w", F.col("e") / (F.sum("e").over(w) + 1e-12))
    total = pairs.groupBy(key, "question").agg(F.sum(F.when(F.col("best") >= threshold, F.col("w") * F.col("s")).otherwise(0.0)).alias("s"))
    per = total.select(key, "question", F.pow("s", F.lit(power)).alias("score"))
    return per.unionByName(per.groupBy(key).agg(F.lit("_total").alias("question"), F.sum("score").alias("score")))


def numbered(df: DataFrame, order: str, to: str = "applicant_id") -> DataFrame:
    """``df`` with ids A0001, A0002, ... by the order of ``order`` (a line number, say), for corpora that come without.

    Places are counted partition by partition, with one small row each, so no task numbers all rows.
    """
    sized = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("p_"), F.monotonically_increasing_id().alias("m_"))
    at = F.col("m_") - F.shiftleft(F.col("p_").cast("long"), 33)
    rows = sized.withColumn("at_", at).drop("m_")
    counts = rows.groupBy("p_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select("p_", (F.sum("n_").over(Window.orderBy("p_")) - F.col("n_")).alias("before_"))  # one row per partition
    return rows.join(F.broadcast(before), "p_").withColumn(to, F.format_string("A%04d", F.col("before_") + F.col("at_") + 1)).drop("p_", "at_", "before_")


def score_deltas(baseline: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, question, baseline, counterfactual, delta) of two long tables of scores."""
    joined = baseline.select(key, "question", F.col("score").alias("baseline")).join(other.select(key, "question", F.col("score").alias("counterfactual")), [key, "question"])
    return joined.withColumn("delta", F.col("counterfactual") - F.col("baseline"))


def lexicon_scores(text: Column, lexicon: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Per document: shares of negative, neutral and positive words, and ``compound``, s / sqrt(s * s + 15) of the summed valences.

    ``lexicon``: a small table (word, valence). A text without words has neg 0, neu 1, pos 0, compound 0. Words are
    counted before the shuffle, a few sums per document.
    """
    words = df.select(F.col(key), F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}']+"), F.lit(0))).alias("word"))
    v = F.coalesce("valence", F.lit(0.0))
    got = words.join(F.broadcast(lexicon), "word", "left").groupBy(key).agg(
        F.sum(v).alias("s"), F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("p"), F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("m"), F.count(F.when(F.col("word").isNotNull() & (v == 0), 1)).alias("z")
    )
    total = F.col("p") + F.col("m") + F.col("z")
    share = lambda c, none: F.coalesce(F.try_divide(F.col(c), total), F.lit(none))
    return got.select(key, share("m", 0.0).alias("neg"), share("z", 1.0).alias("neu"), share("p", 0.0).alias("pos"), (F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)).alias("compound"))


def lexicon_compound(text: Column, lexicon: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return lexicon_scores(text, lexicon, df, key).select(key, "compound")


def join_scores(corpus: DataFrame, scores: DataFrame, key: str, **more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``corpus`` with one or more tables of scores (left joins), and a row (table, unmatched) for each.

    Unmatched rows stay, with null scores: rankings put them last, paired tests leave them out.
    """
    out, marks = corpus, []
    for name, table in {"scores": scores, **more}.items():
        out = out.join(table.withColumn(f"has_{name}", F.lit(True)), key, "left")
        marks.append(name)
    counts = out.select(F.explode(F.array(*(F.struct(F.lit(m).alias("table"), F.col(f"has_{m}").isNull().cast("long").alias("miss")) for m in marks))).alias("x"))
    return out.drop(*(f"has_{m}" for m in marks)), counts.groupBy("x.table").agg(F.sum("x.miss").alias("unmatched"))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``a`` and ``b`` side by side; an error at run time if a key is in one of them only."""
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full")
    whole = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    checked = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("boolean"))
    return both.where(checked).drop("in_a", "in_b")


def density_ratio(df: DataFrame, text: str, pattern: str, tier: str, seed: str, top: str, low: str) -> DataFrame:
    """Mean matches per 100 words of the top and the lower tier per seed, and their ratio."""
    from paritas.functions.texts import token_density

    rows = df.withColumn("d_", token_density(F.col(text), pattern))
    side = lambda t: F.avg(F.when(F.col(tier) == t, F.col("d_")))
    return rows.groupBy(seed).agg(side(top).alias("top"), side(low).alias("low")).withColumn("ratio", ratio(F.col("top"), F.col("low")))


def gap_table(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gaps high minus low at excerpt and document level, and their ratio, per instrument and pair.

    ``scores``: rows (instrument, variant, level, compound); ``pairs``: a few rows (low, high). Pairs with a missing
    variant are left out; the ratio is null where the excerpt gap is as good as 0.
    """
    wide = scores.groupBy("instrument", "variant").agg(*(F.max(F.when(F.col("level") == x, F.col("compound"))).alias(x) for x in ("excerpt", "full_doc")))
    side = lambda s: wide.select("instrument", *(F.col(c).alias(f"{s}_{c}" if c != "variant" else s) for c in ("variant", "excerpt", "full_doc")))
    rows = F.broadcast(pairs).join(side("low"), "low").join(side("high"), ["instrument", "high"])
    gap, full = F.col("high_excerpt") - F.col("low_excerpt"), F.col("high_full_doc") - F.col("low_full_doc")
    return rows.select("instrument", F.concat("high", F.lit(" − "), "low").alias("pair"), gap.alias("excerpt_gap"), full.alias("full_doc_gap"), F.when(F.abs(gap) > 1e-8, ratio(full, gap)).alias("dilution_ratio"))


def dilution_percent(gaps: DataFrame) -> DataFrame:
    """100 (1 - |full| / |excerpt|) per pair (0 where the excerpt gap is 0), and its mean per instrument."""
    rows = gaps.withColumn("dilution_pct", F.when(F.abs("excerpt_gap") <= 1e-9, 0.0).otherwise(F.lit(100.0) * (1 - F.try_divide(F.abs("full_doc_gap"), F.abs("excerpt_gap")))))
    return rows.groupBy("instrument").agg(F.avg("dilution_pct").alias("mean_dilution_pct"), F.count(F.lit(1)).alias("n_pairs"))


LEVELS = ("within_seed_within_stratum", "within_seed_across_stratum", "across_seed")


def distance_means(df: DataFrame, key: str, seed: str, stratum: str, vec: str = "vec") -> DataFrame:
    """Pairs and mean cosine distance at three levels, without forming pairs.

    For unit vectors the sum of all dot products in a set is (|sum v|^2 - sum |v|^2) / 2; three such sums (per seed and
    stratum, per seed, over all) give the levels by subtraction. Linear in rows; vectors are summed before the shuffle.
    """
    long = df.select(seed, stratum, F.posexplode(vec).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    fine = long.groupBy(seed, stratum, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))

    def level(cells: Sequence[str]) -> DataFrame:
        per = fine.groupBy(*cells, "d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
        sets = per.groupBy(*cells).agg((F.sum(F.col("s") * F.col("s")) / 2 - F.sum("q") / 2).alias("dots"), F.max("n").alias("n"))
        return sets.agg(F.sum("dots").alias("dots"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))

    a, b, c = (level(x).select(F.col("dots").alias(f"d{i}"), F.col("pairs").alias(f"p{i}")) for i, x in enumerate(([seed, stratum], [seed], [])))
    one = a.crossJoin(b).crossJoin(c)
    rows = F.array(
        F.struct(F.lit(LEVELS[0]).alias("level"), F.col("p0").alias("n"), F.col("d0").alias("d")),
        F.struct(F.lit(LEVELS[1]).alias("level"), (F.col("p1") - F.col("p0")).alias("n"), (F.col("d1") - F.col("d0")).alias("d")),
        F.struct(F.lit(LEVELS[2]).alias("level"), (F.col("p2") - F.col("p1")).alias("n"), (F.col("d2") - F.col("d1")).alias("d")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.level", F.col("r.n").cast("long").alias("n"), (F.lit(1.0) - F.try_divide(F.col("r.d"), F.col("r.n"))).alias("mean"))


def pair_distances(df: DataFrame, key: str, seed: str, stratum: str, vec: str = "vec", within_seed: bool = False, block: int = 1024) -> DataFrame:
    """Every pair of rows with its cosine distance and level: for medians and percentiles, which need pairs.

    Rows fall into blocks by a hash of the key; each pair of blocks (of a seed, if ``within_seed``) is one task's
    product of two small matrices. The number of pairs grows with the square of the corpus; this is the feature.
    """
    import numpy as np
    import pyarrow as pa

    blocks = max(1, -(-df.count() // block))
    rows = df.select(F.col(key).alias("k"), F.col(seed).alias("s"), F.col(stratum).alias("t"), F.col(vec).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    copies = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("k", "s", "t", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    types = dict(rows.dtypes)

    def product(table: pa.Table) -> pa.Table:
        k, s, t, b = (table.column(c).to_numpy() for c in ("k", "s", "t", "b"))
        order = np.argsort(k, kind="stable")
        k, s, t, b = k[order], s[order], t[order], b[order]
        m = np.array(table.column("v").to_pylist(), dtype=float).reshape(len(k), -1)[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first, second = np.flatnonzero(b == i), np.flatnonzero(b == j)
        near = 1.0 - np.einsum("id,jd->ij", m[first], m[second])
        x, y = np.triu_indices(len(first), 1) if i == j else tuple(z.ravel() for z in np.indices((len(first), len(second))))
        d, x, y = near[x, y], first[x], second[y]
        x, y = np.minimum(x, y), np.maximum(x, y)  # rows are in the order of their keys
        level = np.where(s[x] != s[y], 2, np.where(t[x] == t[y], 0, 1))
        names = pa.array(LEVELS).take(pa.array(level.astype(np.int32)))
        return pa.table({"ka": pa.array(k[x]), "kb": pa.array(k[y]), "seed": pa.array(s[x]), "level": names, "distance": pa.array(d)})

    cells = ["i", "j", "s"] if within_seed else ["i", "j"]
    return copies.groupBy(*cells).applyInArrow(product, f"ka {types['k']}, kb {types['k']}, seed {types['s']}, level string, distance double")


QUANTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}
#: Least rows of a block of vectors, most bytes of one, and pairs that are compared at a time.
BLOCK_ROWS, BLOCK_BYTES, STRIPE = 256, 4 << 20, 1 << 18


def _tallies(low: float, scale: float, regions, wanted):
    """Function of Arrow batches of pairs of blocks: rows (level, region, value, c), the tallies of a task over all its pairs.

    A distance's bin, low and scale give; ``regions`` maps bins to regions. Where ``wanted`` [level, region], the distinct
    distances are returned with their numbers, else their number alone. Region -1 has the sum of a level's distances.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        size = wanted.shape[1]
        counts, sums, kept = np.zeros((3, size), np.int64), np.zeros(3), [[], [], []]
        pick = wanted.any(axis=0)

        def compare(a, b):
            diagonal = b is None
            (sa, ta, va), (sb, tb, vb) = a, b or a
            both = lambda x, y: pa.concat_arrays([x, y]).dictionary_encode().indices.fill_null(-1).to_numpy()
            s, t, cut = both(sa, sb), both(ta, tb), len(va)
            step = max(1, STRIPE // len(vb))
            for at in range(0, len(va), step):
                to, rest = min(at + step, len(va)), at if diagonal else 0
                d = 1.0 - va[at:to] @ vb[rest:].T
                same = s[at:to, None] == s[None, cut + rest :]
                fine = same & (t[at:to, None] == t[None, cut + rest :])
                if diagonal:
                    once = np.triu(np.ones(d.shape, bool), 1)
                    d, same, fine = d[once], same[once], fine[once]
                d, same, fine = d.ravel(), same.ravel(), fine.ravel()
                region = regions[((d - low) * scale).astype(np.int64)]
                near = np.flatnonzero(same)
                inner = fine[near]
                count = lambda r: np.bincount(r, minlength=size)
                every, seed, stratum = count(region), count(region[near]), count(region[near][inner])
                counts[:] += stratum, seed - stratum, every - seed
                every, seed, stratum = d.sum(), d[near].sum(), d[near][inner].sum()
                sums[:] += stratum, seed - stratum, every - seed
                if pick.any():
                    some = np.flatnonzero(pick[region])
                    level = 2 - same[some].astype(int) - fine[some]
                    use = wanted[level, region[some]]
                    for i in range(3):
                        kept[i].append(d[some[use & (level == i)]])

        held = None
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for r in range(batch.num_rows):
                i, j = columns["i"][r].as_py(), columns["j"][r].as_py()
                n = len(columns["s"][r].values)
                m = np.frombuffer(columns["m"][r].as_buffer(), np.float32 if columns["single"][r].as_py() else np.float64).reshape(n, -1).astype(np.float64)
                own = (columns["s"][r].values, columns["t"][r].values, m)
                if i == j:
                    compare(own, None)
                elif held and held[0] == (i, j):
                    compare(held[1], own)
                else:
                    held = (i, j), own
        out = [(np.full(3, -1), np.arange(3), sums, np.zeros(3, np.int64))]
        for level in range(3):
            there = np.flatnonzero((counts[level] > 0) & ~wanted[level])
            out.append((there, np.full(len(there), level), np.full(len(there), np.nan), counts[level][there]))
            values, c = np.unique(np.concatenate([np.empty(0), *kept[level]]), return_counts=True)
            out.append((regions[((values - low) * scale).astype(np.int64)], np.full(len(values), level), values, c))
        region, level, value, c = (np.concatenate(x) for x in zip(*out, strict=True))
        for at in range(0, len(c), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(level[part].astype(np.int32)), pa.array(region[part].astype(np.int32)), pa.array(value[part]), pa.array(c[part].astype(np.int64))], ["level", "region", "value", "c"])

    return run


def distance_levels(df: DataFrame, key: str, seed: str, stratum: str, vec: str = "vec") -> DataFrame:
    """n, mean, median, tenth and ninetieth percentile of the cosine distances of all pairs at each level, exact, without a row per pair.

    All pairs are compared twice, as products of blocks of vectors. First distances are counted by level and bin; then the
    distances in the bins that hold the percentiles are kept, one row for equal ones, and those of the wanted ranks taken.
    """
    import math

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(seed).alias("s"), F.col(stratum).alias("t"), F.col(vec).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, shortest, longest, most, known = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v")), F.max(norm), F.count(norm)).first()
    if n and (shortest != longest or known < n or not math.isfinite(most)):
        raise ValueError("vectors must be of one length, without missing values")
    types, single = dict(rows.dtypes), dict(rows.dtypes)["v"] == "array<float>"
    block = max(BLOCK_ROWS, min(-(-n // 16), BLOCK_BYTES // max(1, (longest or 1) * (4 if single else 8))))
    blocks = max(1, -(-n // block))

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("k", "ascending")])).combine_chunks()
        one = lambda c: pa.ListArray.from_arrays([0, table.num_rows], table.column(c).combine_chunks())
        m = pc.list_flatten(table.column("v").combine_chunks()).to_numpy().astype(np.float32 if single else np.float64)
        return pa.table({"b": table.column("b")[:1], "s": one("s"), "t": one("t"), "m": pa.array([m.tobytes()], pa.binary())})

    packed = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(pack, f"b int, s array<{types['s']}>, t array<{types['t']}>, m binary")
    pairs = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "s", "t", "m", F.lit(single).alias("single"))
    pairs = pairs.repartition(min(blocks * (blocks + 1) // 2, 500), "i", "j").sortWithinPartitions("i", "j", "b")

    # a bin holds about as many pairs as there are bins
    bins = 1 << max(10, min(20, round(math.log2(max(1, n * n / 2)) / 2)))
    low = 1 - (most or 0) * (1 + 1e-9) - 1e-9
    scale = (bins - 1) / (2 * (1 - low))
    schema = "level int, region int, value double, c long"
    tally = lambda regions, wanted: pairs.mapInArrow(_tallies(low, scale, regions, wanted), schema)
    got = tally(np.arange(bins), np.zeros((3, bins), bool)).groupBy("level", "region").agg(F.sum("value").alias("value"), F.sum("c").alias("c")).toArrow()
    level, region, value, c = (got.column(x).to_numpy() for x in ("level", "region", "value", "c"))
    counts, stats, held = np.zeros((3, bins), np.int64), [], np.zeros((3, bins), bool)
    binned = region >= 0
    counts[level[binned], region[binned]] = c[binned]
    for i, name in enumerate(LEVELS):
        if size := int(counts[i].sum()):
            places = [q * (size - 1) for q in QUANTILES.values()]
            ranks = [r for p in places for r in (math.floor(p), math.ceil(p))]
            held[i, np.searchsorted(np.cumsum(counts[i]), ranks, side="right")] = True
            stats.append((i, name, size, float(value[(level == i) & ~binned][0]) / size, places))
    # regions: the bins that hold a wanted rank of any level, and what lies between them
    bound = held.any(axis=0)
    regions = 2 * np.cumsum(bound) - bound
    wanted = np.zeros((3, int(regions[-1]) + 1), bool)
    for i in range(3):
        wanted[i, regions[held[i]]] = True
    steps = tally(regions, wanted).where("region >= 0").groupBy("level", "region", "value").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("level").orderBy("region", "value").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("upto", upto).withColumn("above", F.col("upto") - F.col("c")).select(F.col("level").alias("i"), "value", "upto", "above")
    stats = spark.createDataFrame(stats, "i int, level string, n long, mean double, places array<double>")
    asked = stats.select("i", "level", "n", "mean", F.posexplode("places").alias("q", "place"))
    has = lambda r: (F.col("above") <= r) & (F.col("upto") > r)
    below, over = F.floor("place"), F.ceil("place")
    met = steps.join(F.broadcast(asked), "i").where(has(below) | has(over))
    ends = met.groupBy("level", "n", "mean", "q", "place").agg(F.max(F.when(has(below), F.col("value"))).alias("x"), F.max(F.when(has(over), F.col("value"))).alias("y"))
    share = F.col("place") - F.floor("place")
    at = ends.withColumn("x", F.col("x") * (1 - share) + F.col("y") * share)
    return at.groupBy("level", "n", "mean").agg(*(F.max(F.when(F.col("q") == i, F.col("x"))).alias(name) for i, name in enumerate(QUANTILES)))


def summarise(df: DataFrame, value: str, cells: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, tenth and ninetieth percentile."""
    q = df.groupBy(*cells).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("q"))
    return q.select(*cells, "n", "mean", *(F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("median", "p10", "p90"))))
