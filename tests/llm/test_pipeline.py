"""The corpus pipeline against a version in plain Python, and its near-dedup stage against exact pairs."""

import base64
import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import test_operators as brute

import corpus_pipeline
from paritas.llm import quality, simhash


def passes(text):
    """The quality policy from the text itself."""
    text = text or ""
    words, seen, dups, lines = brute.SPACED.findall(text), set(), 0, 0
    count, repeat = collections.Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            repeat |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if brute.SPACED.search(line):
            lines, dups = lines + 1, dups + (line in seen)
            seen.add(line)
    n, chars, letters = len(words), sum(map(len, words)), [c for c in text if c.isalpha()]
    failed = {
        "few_words": n < 50, "repeated_windows": 100 * len(repeat) > 50 * n, "symbols": 5 * sum(c in "#*$%&|<>" for c in text) > n, "repeated_lines": 2 * dups > lines,
        "upper_case": 2 * sum(c.isupper() for c in text) > len(letters), "few_letters": 2 * len(letters) < chars, "short_words": chars < 2 * n, "long_words": chars > 20 * n, "marks": sum(c in "!?" for c in text) > n,
    }
    return not any(failed[rule] for rule in quality.POLICIES[quality.DEFAULT_POLICY])


def lines_kept(rows):
    """Texts without the lines that equal or nearly equal an earlier one; those that lose all lines with words go."""
    near = lambda a, b: any(brute.line_dedup.within_one(list(a), list(x)) for x in b)
    first, by, gone, out = {}, collections.defaultdict(list), set(), []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = tuple(brute.WORD.findall(line.translate(brute.LOW)))
            if w and w not in first:
                first[w] = (doc, i)
                if len(w) > 1:
                    if near(w, by[len(w) - 1] + by[len(w)] + by[len(w) + 1]):
                        gone.add(w)
                    by[len(w)].append(w)
    for doc, text in rows:
        kept, had, left = [], 0, 0
        for i, line in enumerate((text or "").split("\n")):
            w = tuple(brute.WORD.findall(line.translate(brute.LOW)))
            stays = not w or first[w] == (doc, i) and w not in gone
            had, left = had + bool(w), left + bool(w and stays)
            kept += [line] * stays
        if left or not had:
            out.append((doc, None if text is None else "\n".join(kept)))
    return out


def shingles(text):
    words = brute.SPACED.findall((text or "").translate(brute.LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_pairs(rows):
    """Pairs of documents at an exact similarity of 0.8 or more, by shared shingles."""
    sets, by = {doc: shingles(text) for doc, text in rows}, collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s or {None}:
            by[x].append(doc)
    common = collections.Counter((a, b) for docs in by.values() for i, a in enumerate(docs) for b in docs[:i])
    return {p: n / max(1, len(sets[p[0]] | sets[p[1]])) if sets[p[0]] else 1.0 for p, n in common.items() if not sets[p[0]] or 5 * n >= 4 * len(sets[p[0]] | sets[p[1]])}


def components(docs, pairs):
    label = {d: d for d in docs}
    while True:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            return label


def cleaned(text, items):
    """Without the text between the first and the last word of each run of hit words."""
    low = (text or "").translate(brute.LOW)
    places, hit = [m.span() for m in brute.WORD.finditer(low)], set()
    words = [low[a:b] for a, b in places]
    for item in items:
        size = min(10, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(words) - size + 1) if item else ():
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
    if 2 * len(hit) > len(words):
        return None
    for i in sorted(hit, reverse=True):
        if i - 1 not in hit:  # the run's first word: cut to its last one
            j = i
            while j + 1 in hit:
                j += 1
            text = text[: places[i][0]] + text[places[j][1] :]
    return text


def plain_pipeline(documents, benchmark):
    import tiktoken

    rows = lines_kept([(d, t) for d, t in documents if passes(t)])
    label = components([d for d, _ in rows], exact_pairs(rows))
    rows = [(d, t) for d, t in rows if label[d] == d]
    items = [brute.WORD.findall((t or "").translate(brute.LOW)) for t in benchmark]
    rows = [(d, c) for d, t in rows if (c := cleaned(t, items)) is not None or t is None]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        out[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    return out


def test_pipeline_by_brute_force(spark, sf, duck):
    documents = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    want = plain_pipeline(documents, [t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()])
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert 50 < len(want) < len(documents)
    assert got == want


@pytest.fixture(scope="module")
def larger(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    return docs, sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_recall_of_near_documents(spark, larger):
    """Every pair at 0.8 or more of the whole table ends in one component, and nothing else is linked."""
    docs, rows = larger
    pairs = exact_pairs(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    linked = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 100 and any(x < 1 for x in pairs.values()) and linked >= 0.999 * len(pairs)
    assert components([d for d, _ in rows], pairs) == got


def test_blocks_widen_with_the_documents():
    for n in (1, 10**6, 10**8, 10**10):
        blocks = simhash.wide_blocks(n)
        width = len(blocks[0])
        assert n / 2**width <= simhash.WIDE_BUCKET and (1 - (1 - simhash.WIDE_APART) ** width) ** len(blocks) <= simhash.WIDE_MISS
    assert len(simhash.wide_blocks(10**10)) < 400 and simhash.sample_size(10**11) == simhash.PER_SHARD * simhash.SHARDS


def test_wide_blocks_find_the_same(spark, larger, monkeypatch):
    """Blocks as for many documents, and small shards: the same components."""
    docs, rows = larger
    monkeypatch.setattr(simhash, "WIDE_BUCKET", 0.02)
    assert len(simhash.wide_blocks(len(rows))[0]) > 15
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, shard=64).collect()}
    assert got == components([d for d, _ in rows], exact_pairs(rows))


@pytest.mark.parametrize("part", [5, 40])
def test_large_components_part_by_part(spark, part):
    """Sets around a few centres, as one candidate component: the links of all parts give the groups of all pairs."""
    rng = np.random.default_rng(3)
    centres = [rng.choice(2000, 60, replace=False) for _ in range(5)]
    sets = [np.zeros(0, np.uint64)] * 2 + [np.unique(np.concatenate([rng.permutation(centres[i % 5])[: 60 - int(rng.integers(0, 12))], rng.integers(0, 2000, int(rng.integers(0, 6)))])).astype(np.uint64) for i in range(118)]
    ids = (rng.permutation(120) + 1).tolist()
    rows = [(i, s.tobytes(), min(ids), 120) for i, s in zip(ids, sets)] + [(200 + i, s.tobytes(), 200, 3) for i, s in enumerate(sets[:1] + sets[5:7])]
    frame = spark.createDataFrame(rows, "id long, hashes binary, root long, n long")
    sizes = spark.createDataFrame([(min(ids), 120), (200, 3)], "root long, n long")
    got = [(r["a"], r["b"]) for r in simhash.exact_links(frame, sizes, part=part).collect()]
    of = {r[0]: {*np.frombuffer(r[1], np.uint64).tolist()} for r in rows}
    exact = [(a, b) for a in of for b in of if a > b and (a < 200) == (b < 200) and (5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]))]
    assert components(of, got) == components(of, exact)
    assert 5 < len(set(components(of, exact).values())) < 110


def test_pipeline_components_part_by_part(spark, larger, monkeypatch):
    docs, rows = larger
    monkeypatch.setattr(simhash, "PART", 3)
    monkeypatch.setattr(simhash.exact_links, "__defaults__", (simhash.WIDE_SIMILARITY, 3))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert got == components([d for d, _ in rows], exact_pairs(rows))
