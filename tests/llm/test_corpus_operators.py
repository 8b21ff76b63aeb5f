"""Operators that compare documents with each other, against brute force; the pipeline."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import ODD_ROWS, rows_of
from tests.llm.test_map_operators import all_distances
from tidemark.llm import (
    blocks, components, decontaminate, elias_fano, exact_dedup, jaccard_join, lm_score, registry, substring_dedup, words,
)

ODD = [(i, t) for i, t, _ in ODD_ROWS]


# --- words

@given(st.binary(max_size=200))
def test_words_are_those_of_split(raw):
    begin, end = words.word_spans(raw)
    found = [raw[a:b] for a, b in zip(begin, end, strict=True)]
    assert found == raw.split()
    hashes = words.word_hashes(raw, begin, end)
    assert len({(int(a), int(b)) for a, b in hashes.T}) == len(set(found))


# --- exact dedup

@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operators_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in registry.queries()[name](spark, small).select(*names).collect())


@pytest.mark.parametrize("size", [4, 64, 8192])
def test_exact_dedup_odd_rows(odd, none, size):
    rows = exact_dedup.exact_dedup(odd, block_bytes=size) if size > 4 else exact_dedup.exact_dedup(odd.where("doc_id <> 5 and doc_id <> 8 or doc_id is null"), block_bytes=size)
    got = Counter((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows.collect())
    rest = {} if size == 4 else {("5", "5", 1, True): 1, ("8", "8", 1, True): 1}
    assert got == Counter({
        ("1", "1", 2, True): 1, ("None", "1", 2, False): 1, ("2", "2", 2, True): 1, ("3", "2", 2, False): 1, ("4", "4", 1, True): 1,
        ("6", "6", 2, True): 1, ("6", "6", 2, False): 1, ("7", "7", 1, True): 2, **rest})
    if size == 8192:
        assert exact_dedup.exact_dedup(none).count() == 0
        kept = exact_dedup.without_copies(odd)
        assert kept.columns == odd.columns and kept.count() == len(ODD_ROWS) - 3


# --- substring dedup

def brute_windows(rows, width=13):
    key = lambda i: math.inf if i is None else i
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            first[k] = min(first.get(k, math.inf), key(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < key(i):
                gone[a : a + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def as_rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substring_dedup(spark, small, odd, none):
    assert as_rows(registry.op6_substring_dedup(spark, small)) == brute_windows(rows_of(spark, small))
    found = substring_dedup.duplicate_factors(odd, block_bytes=1000)
    assert as_rows(found.withColumn("kept_sha256", F.sha2("text", 256))) == brute_windows(ODD)
    assert substring_dedup.duplicate_factors(none).count() == 0


def test_substring_factors_are_greedy(spark):
    """A match goes on in the document it is found in, also where an earlier document has the first part of it."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:20])), (2, " ".join(["x", *words[:40]])), (3, " ".join(["y", *words[:40], "z"])),
            (4, " ".join([*words[30:40], *words[:20]])), (5, " ".join([*words[5:20], *words[2:25]]))]
    found = substring_dedup.duplicate_factors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=120)
    factors = {r.doc_id: [tuple(f) for f in r.factors] for r in found.collect()}
    assert factors == {1: [], 2: [(1, 20, 1)], 3: [(1, 40, 2)], 4: [(10, 20, 1)], 5: [(0, 15, 1), (15, 23, 2)]}


def test_substring_factors_are_in_their_sources(spark, small):
    texts = dict(rows_of(spark, small))
    found = substring_dedup.duplicate_factors(spark.read.parquet(f"{small}/documents.parquet"), block_bytes=40_000).collect()
    assert any(len(r.factors) > 1 for r in found)
    for r in found:
        own, end = texts[r.doc_id].encode().split(), 0
        for f in r.factors:
            assert f.start >= end and f.length >= substring_dedup.WIDTH and f.source < r.doc_id
            source = b" " + b" ".join(texts[f.source].encode().split()) + b" "
            assert b" " + b" ".join(own[f.start : f.start + f.length]) + b" " in source
            end = f.start + f.length


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.data())
def test_removed_words_come_from_factors(flags, data):
    """Factors that cover each stretch remove what the windows cover; without a factor its words stay."""
    width, found = 4, np.array([*flags, *[False] * 5])
    windows = np.flatnonzero(found)
    expected = np.zeros(len(found), bool)
    for w in windows:
        expected[w : w + width] = True
    factors, at = [], 0
    while at < len(found):
        if found[at]:
            end = at
            while found[end]:
                end += 1
            most = end - 1 + width
            while at + width <= most:
                n = data.draw(st.integers(width, most - at))
                factors.append((at, n))
                at += n
            at = end
        else:
            at += 1
    assert (substring_dedup.removed_words(found, factors, width) == expected).all()
    assert not substring_dedup.removed_words(found, [], width).any()


# --- Jaccard join

def brute_components(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[a : a + width]) for a in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    holders = {}
    for a, (_, s) in enumerate(sets):
        near = Counter(b for e in s for b in holders.get(e, ()))
        for b, both in near.items():
            if den * both >= num * (len(s) + len(sets[b][1]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
        for e in s:
            holders.setdefault(e, []).append(a)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted((str(i), len(s), str(least.get(root(a)) if s else i)) for a, (i, s) in enumerate(sets))


def joined(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_jaccard_join_query(spark, small):
    assert joined(registry.op9_jaccard_join(spark, small)) == brute_components(rows_of(spark, small), 3, 9, 10)


def test_jaccard_sets_of_a_block_take_little_memory():
    """What a block's sets take while they are made: 11.5 times its texts when all was hashed at once."""
    texts = [b" ".join(b"w%d" % (k * k % 9973) for k in range(n, n + 900)) for n in range(700)] + [b"one", b"", b"two words"]
    sizes = np.array([len(t) for t in texts], np.int64)
    row = {"block": 1, "ids": list(range(len(texts))), "sizes": sizes.tobytes(), "size": int(sizes.sum()),
           "text": zstandard.ZstdCompressor().compress(b"\n".join(texts))}
    tracemalloc.start()
    try:
        sets = jaccard_join.shingle_sets(blocks.read_block(row, lower=True, lanes=1), 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8.5 * sizes.sum()
    # Each text on its own is hashed in one go.
    for d in (0, 351, 699, 700, 701, 702):
        alone = row | {"ids": [d], "sizes": sizes[d : d + 1].tobytes(), "text": zstandard.ZstdCompressor().compress(texts[d])}
        assert np.array_equal(jaccard_join.shingle_sets(blocks.read_block(alone, lower=True, lanes=1), 5)[0], sets[d])


def test_jaccard_join_odd_rows(odd, none):
    assert joined(jaccard_join.similar_components(odd, block_bytes=1000)) == brute_components(ODD, 5, 4, 5)
    assert jaccard_join.similar_components(none).count() == 0
    kept = jaccard_join.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "7"]


@pytest.mark.parametrize("wide", [jaccard_join.WIDE, 9])
def test_jaccard_join_families(spark, monkeypatch, wide):
    """Edited copies of some texts, at all distances around the threshold; wide clusters go in slices."""
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    draw = np.random.default_rng(5)
    rows, n = [], 0
    for family in range(6):
        base = [f"f{family}w{k}" for k in draw.integers(0, 60, 50)]
        for _ in range(25):
            text = list(base)
            for at in draw.integers(0, len(text), draw.integers(0, 5)):
                text[at] = f"e{draw.integers(0, 40)}"
            rows.append((n, " ".join(text)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num, den in ((1, 2), (4, 5), (9, 10)):
        assert joined(jaccard_join.similar_components(docs, width=3, num=num, den=den, block_bytes=2000)) == brute_components(rows, 3, num, den)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=14), min_size=2, max_size=25), st.sampled_from([(1, 2), (4, 5), (9, 10)]))
def test_cluster_links_by_pivots_equal_all_pairs(sets, ratio):
    t = jaccard_join.Threshold(*ratio)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    expected, found = jaccard_join.Forest(len(sets)), jaccard_join.Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if ratio[1] * len(a & sets[j]) >= ratio[0] * len(a | sets[j]):
                expected.join(i, j)
    dense, jaccard_join.DENSE = jaccard_join.DENSE, 0
    try:
        for i, j in jaccard_join.cluster_links(arrays, t):
            assert ratio[1] * len(sets[i] & sets[j]) >= ratio[0] * len(sets[i] | sets[j])
            found.join(i, j)
    finally:
        jaccard_join.DENSE = dense
    assert [expected.root(i) for i in range(len(sets))] == [found.root(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5), *((k, k + 1) for k in range(100, 140))]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **{k: 100 for k in range(100, 141)}}


# --- language model

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12), max_size=60), st.lists(st.integers(0, 10**12), max_size=20))
def test_elias_fano(values, asked):
    values = np.array(sorted(values), np.int64)
    buffer = elias_fano.Buffer()
    elias_fano.EliasFano.put(values, buffer)
    packed = elias_fano.EliasFano.take(buffer.mapped())
    assert packed.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.array([*asked, *values], np.int64)
    expected = [int(np.searchsorted(values, a)) if a in values else -1 for a in asked]
    assert packed.search(asked).tolist() == expected


def check_scores(rows, got):
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, w in texts:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(one.values()), len(one)
    s = lm_score.Smoothing.of(np.stack([lm_score._statistics(np.array(list(c.values()), np.int64)) for c in (one, two, three)]))
    m, k = s.masses
    expected = []
    for i, w in texts:
        total = 0.0
        for a, x in enumerate(w):
            p = float(s.word(np.array([one[x]]))[0])
            if a >= 1:
                p = (two[w[a - 1], x] + m * p) / (one[w[a - 1]] + m)
            if a >= 2 and two[w[a - 2], w[a - 1]]:
                p = (three[w[a - 2], w[a - 1], x] + k * p) / (two[w[a - 2], w[a - 1]] + k)
            total += math.log10(p)
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        expected.append((str(i), len(w), sum(one[x] > 0 for x in w), n, base, total))
    found = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    assert len(found) == len(expected)
    for a, b in zip(sorted(expected), sorted(found), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-6) and abs(a[5] - b[5]) < 0.03 * a[1]


def test_lm_scores(spark, small, odd, none):
    got = registry.op1_lm_score(spark, small).collect()
    check_scores(rows_of(spark, small), got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    check_scores(ODD, lm_score.score_documents(odd, block_bytes=1000).collect())
    assert lm_score.score_documents(none).count() == 0


def scores(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_trained_model_scores_texts(spark, small, odd, none, tmp_path):
    """A stored model gives what the corpus gives itself, and scores texts that it has not seen."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lm_score.train_model(docs).save(str(tmp_path / "model"))
    model = lm_score.LanguageModel.load(spark, str(tmp_path / "model"))
    own = registry.op1_lm_score(spark, small)
    assert scores(lm_score.score_with(docs, model)) == scores(own)
    check_scores(rows_of(spark, small), lm_score.score_with(docs, model, block_bytes=20_000).collect())
    texts = {"1": "the of and", "2": "zzzz qqqq xxxx", "3": None}
    other = {r.doc_id: r for r in lm_score.score_with(spark.createDataFrame(list(texts.items()), "doc_id string, text string"), model).collect()}
    assert other[1].n_known > other[2].n_known == 1 and other[1].score > other[2].score and other[3].n_tokens == 1
    assert sum(10 ** r.score for r in other.values()) < 1
    assert {r.train_tokens for r in other.values()} == {own.first().train_tokens}
    assert lm_score.score_with(none, model).count() == 0 and lm_score.score_with(odd, lm_score.train_model(none)).count() == len(ODD_ROWS)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 40), st.integers(0, 3)), st.integers(1, 10**6), max_size=40),
       st.lists(st.tuples(st.integers(0, 45), st.integers(0, 4)), max_size=20), st.sampled_from([0, 24]))
def test_levels_of_a_model(known, asked, shift):
    """Keys that are alike are told apart by their other bits."""
    rows = sorted(known)
    array = lambda values, kind: np.array(values, kind)
    keys, more = array([k << shift for k, _ in rows], np.uint64), array([m for _, m in rows], "<u8")
    level = lm_score._packed_level(keys, more, array([known[r] for r in rows], np.int64), shift)
    found = lm_score._found_counts(level, array([k << shift for k, _ in asked], np.uint64), array([m for _, m in asked], "<u8"), shift)
    assert found.tolist() == [known.get(a, 0) for a in asked]


def test_texts_that_ask_for_what_only_held_out_rows_have(spark):
    """All n-grams of the corpus come from held-out rows, so every level is empty but for what no text asks."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    docs = spark.createDataFrame([(i, f"only here {i} and nowhere else") for i in held], "doc_id long, text string")
    model = lm_score.train_model(docs)
    got = lm_score.score_with(docs, model).collect()
    assert len(got) == 5 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    one = spark.createDataFrame([(held[0], "seen by nobody"), (0 if 0 not in held else 2, "known words")], "doc_id long, text string")
    mixed = lm_score.train_model(docs.union(one))
    assert lm_score.score_with(docs, mixed).count() == 5


def exact_scores(rows):
    """Scores in plain numbers, with smoothing of its own: masses by bisection over the counts themselves."""
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, w in texts:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    total, once, twice = sum(one.values()), sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    discount = once / (once + 2 * twice) if once else 0.5

    def mass(lower, upper):
        bins = {}
        for c in lower.values():
            n, s = bins.get(c.bit_length(), (0, 0))
            bins[c.bit_length()] = (n + 1, s + c)
        single, low, high = sum(c == 1 for c in upper.values()), 1e-3, 1e9
        for _ in range(100):
            middle = math.sqrt(low * high)
            if sum(s * middle / (s / n + middle) for n, s in bins.values()) < single:
                low = middle
            else:
                high = middle
        return low

    m, k = mass(one, two), mass(two, three)
    out = {}
    for i, w in texts:
        score = 0.0
        for a, x in enumerate(w):
            p = max(one[x] - discount, 0) / total + discount * len(one) / total / (len(one) + 1)
            if a >= 1:
                p = (two[w[a - 1], x] + m * p) / (one[w[a - 1]] + m)
            if a >= 2 and two[w[a - 2], w[a - 1]]:
                p = (three[w[a - 2], w[a - 1], x] + k * p) / (two[w[a - 2], w[a - 1]] + k)
            score += math.log10(p)
        out[i] = score
    return out


def test_lm_scores_are_exact_before_quantisation(spark, small, monkeypatch):
    """One block of documents in this process, with weights as they are instead of one byte each."""
    from tidemark.llm import blocks as B

    def whole(values, to):
        levels, codes = np.unique(values, return_inverse=True)
        to.put(codes.astype(np.int64))
        to.put(levels if len(levels) else np.ones(1))

    monkeypatch.setattr(elias_fano, "_quantised", whole)
    rows = rows_of(spark, small)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    block = B.read_block(B.pack_blocks(docs, block_bytes=1 << 30).first().asDict(), lower=True)
    t = lm_score.tokens_of(block, np.uint64(2**64 - 2**20))
    train = ~t.unknown
    one = np.bincount(t.words[train], minlength=t.hashes.shape[1])
    counts, stats = [], [lm_score._statistics(one)]
    for keys, least in zip(t.keys, (1, 2), strict=True):
        own = t.depth >= least
        names, number = np.unique(keys[own], return_inverse=True)
        counts.append(np.bincount(number[train[own]], minlength=len(names)))
        stats.append(lm_score._statistics(counts[-1]))
    logs = np.log10(lm_score._scored(t, one, counts, lm_score.Smoothing.of(np.stack(stats))))
    found, expected = np.add.reduceat(logs, t.starts[:-1]), exact_scores(rows)
    assert np.allclose(found, [expected[i] for i in block.ids], rtol=1e-9, atol=1e-7)


# --- pipeline

def test_pipeline_stages(spark, small, tmp_path):
    """Each stage keeps what a plain version of its rule keeps, no more and no less."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert min(map(len, items)) >= decontaminate.MIN_CHARS
    library = Tokenizer.from_file(registry.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == names and after < set(before)
        if name == "quality":
            # The scores of this query are held against plain numpy elsewhere.
            assert after == {r.doc_id for r in registry.op2_quality(spark, small).collect() if r.predicted == 1}
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub("[ \t-\r]+", " ", before[d] or ""), d)
            assert after == set(first.values())
        elif name == "jaccard_join":
            assert {str(d) for d in after} == {c for _, _, c in brute_components(list(before.items()), 5, 4, 5)}
        elif name == "decontamination":
            ids, gap = list(before), "\0" * (max(map(len, items)) + 1)
            texts = [decontaminate.plain(before[d] or "") for d in ids]
            starts, joined, leaks = np.cumsum([0] + [len(t) + len(gap) for t in texts]), gap.join(texts), set()
            for item in items:
                ends = np.flatnonzero(all_distances(item, joined) <= len(item) // decontaminate.CHARS_PER_EDIT)
                leaks |= {ids[k] for k in np.searchsorted(starts, ends, side="right") - 1}
            assert after == set(before) - leaks
        else:
            codes = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in docs.collect()}
            assert codes == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in before.items()}


def test_pipeline_stages_on_odd_rows(spark, small, odd, none):
    """Nulls, empty and long texts, repeated rows and ids, and columns that could clash."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, small)
        if name != "bpe":
            assert out.columns == odd.columns
        kept = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert not kept - Counter(i for i, _ in ODD)
        if name in ("decontamination", "bpe"):
            assert sum(kept.values()) == len(ODD)
        elif name == "exact_dedup":
            assert sum(kept.values()) == len(ODD) - 3
        assert stage(spark, none, small).count() == 0
