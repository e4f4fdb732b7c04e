"""Near copies by shingle sets against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import set_similarity, simhash


def shingles(text, words=5):
    own = text.lower().split()
    return {" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def components_truth(texts, similarity):
    """Number of the first text of each text's component."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if 4 * min(len(sets[i]), len(sets[j])) >= 3 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= similarity:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def components_found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, 8, shingle=2, similarity=0.8).collect()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    return [got[i].component_id for i in range(len(texts))]


def variants(rng, n, words, edits):
    """``n`` texts from one template, each with its own words in ``edits`` places."""
    base = [f"t{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"v{k}x{rng.randrange(10**6)}"
        out.append(own)
    return out


def test_true_pairs_of_a_template_group(spark):
    rng = random.Random(1)
    group = variants(rng, 240, 400, 9)
    longer = [t + [f"more{rng.randrange(10**6)}" for _ in range(50)] for t in group[:60]]
    texts = [" ".join(t) for t in group + longer]
    truth = components_truth(texts, 0.8)
    assert len(set(truth)) > 200 and all(truth[240 + i] == truth[i] for i in range(60))
    assert components_found(spark, texts) == truth


def test_equal_fingerprints_are_no_copies(spark):
    """Texts dominated by one repeated pair of words (la la) have one fingerprint."""
    rng = random.Random(2)
    texts = [" ".join([*(f"w{i}x{rng.randrange(10**6)}" for _ in range(60)), *["la"] * 400]) for i in range(6)]
    texts += [t + " tail" for t in texts[3:]]
    assert len({simhash.fingerprint(t.encode(), 2) for t in texts[:6]}) < 6
    truth = components_truth(texts, 0.8)
    assert truth == [0, 1, 2, 3, 4, 5, 3, 4, 5]
    assert components_found(spark, texts) == truth


def edited(rng, words, kind, share):
    new = [f"n{rng.randrange(10**6)}" for _ in range(int(share * len(words)))]
    if kind == "header":
        return new + words
    if kind == "footer":
        return words + new
    own = list(words)
    for at in rng.sample(range(len(words)), len(new) // 9):  # every changed word breaks five shingles, and makes five
        own[at] = f"c{rng.randrange(10**6)}"
    return own


def test_every_pair_of_every_band_and_kind_of_edit(spark):
    rng = random.Random(3)
    pairs = []
    for kind in ("header", "footer", "scattered"):
        for n in (100, 400):
            for share in (0.06, 0.1, 0.15, 0.2, 0.24, 0.28):
                for _ in range(5):
                    words = [f"w{rng.randrange(4000)}" for _ in range(n)]
                    pairs.append((kind, words, edited(rng, words, kind, share)))
    texts = [" ".join(p[1]) for p in pairs] + [" ".join(p[2]) for p in pairs]
    found = components_found(spark, texts)
    near, lost = Counter(), Counter()
    for i, (kind, _, _) in enumerate(pairs):
        j = jaccard(shingles(texts[i]), shingles(texts[len(pairs) + i]))
        together = found[len(pairs) + i] == found[i]
        if j >= 0.8:
            near[kind, int(j * 20)] += 1
            lost[kind, int(j * 20)] += not together
        else:
            assert not together, (kind, j)
    assert all(near[kind, band] for kind in ("header", "footer") for band in (16, 17, 18)) and near["scattered", 16]
    assert sum(lost.values()) == 0, lost


def test_crowded_keys(spark):
    """More texts share every key than meet in one task; some differ from the first text of the key, but not from another."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    chain = [base[: 120 - 6 * k] + [f"c{i}" for i in range(6 * k)] for k in range(4)]  # neighbours are alike, ends are not
    texts = [" ".join([*chain[i % 4], f"own{i}"]) for i in range(1200)]
    texts += [" ".join([*base[:60], *(f"x{i}y{rng.randrange(10**6)}" for _ in range(20))]) for i in range(300)]
    first = {k: jaccard(shingles(texts[0]), shingles(texts[k])) for k in range(4)}
    assert first[1] >= 0.8 > first[3]
    found = components_found(spark, texts)
    assert found[:1200] == [0] * 1200 and found[1200:] == list(range(1200, 1500))


@pytest.mark.parametrize("crowd, block", [(16, 64), (16, 1 << 16), (256, 64)])
def test_crowded_keys_that_no_sample_shows(spark, monkeypatch, crowd, block):
    """Keys are found to be crowded where they meet, also when their texts fill several batches."""
    none = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(set_similarity, "common_shingles", lambda rows, words: (none, none))
    monkeypatch.setattr(set_similarity, "CROWD", crowd)
    monkeypatch.setattr(set_similarity, "BLOCK", block)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(60)]
    chain = [base[: 60 - 4 * k] + [f"c{i}" for i in range(4 * k)] for k in range(3)]
    texts = [" ".join([*chain[i % 3], f"own{i}"]) for i in range(150)]
    texts += [" ".join([*base[:20], *(f"x{i}y{rng.randrange(10**6)}" for _ in range(12))]) for i in range(80)]
    texts += [t + " tail" for t in texts[150:170]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in set_similarity.similar_texts(docs, 0.8).collect()}
    assert [found[i] for i in range(len(texts))] == components_truth(texts, 0.8)


def test_bitmaps_never_differ_in_more_bits_than_their_sets():
    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 5, 700, 1024, 1025, 3000, 9000):
        own = rng.integers(-(2**63), 2**63 - 1, size=n, dtype=np.int64)
        sets += [np.unique(own), np.unique(np.concatenate([own[: n - n // 8], rng.integers(0, 2**62, size=n // 4)]))]
    pairs = [(x, y) for x in sets for y in sets]
    maps = [pa.array([set_similarity.parity(p[i]) for p in pairs], pa.binary()) for i in (0, 1)]
    apart = set_similarity.bits_apart(*maps)
    true = np.array([len(np.setxor1d(x, y)) for x, y in pairs])
    assert (apart <= true).all()
    assert all(apart[i] == 0 for i, (x, y) in enumerate(pairs) if x is y)
    # Long sets with nothing in common stay apart: their bitmaps are not full.
    x, y = sets[-2], rng.integers(-(2**63), 2**63 - 1, size=9000, dtype=np.int64)
    far = set_similarity.bits_apart(*(pa.array([set_similarity.parity(np.unique(v))], pa.binary()) for v in (x, y)))[0]
    assert far > (1 - 0.8) / (1 + 0.8) * (len(x) + len(y))


def test_repeated_rows_and_empty_tables(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (1, base), (2, base + " more"), (2, base + " more"), (3, None), (3, ""), (None, base + " of this"), (4, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in set_similarity.similar_texts(docs, 0.8).select("doc_id", "component_id", "kept").collect())
    assert found == Counter({(1, 1, True): 2, (2, 1, False): 2, (3, 3, True): 2, (None, 1, False): 1, (4, 4, True): 1})
    assert set_similarity.similar_texts(docs.limit(0), 0.8).count() == 0


def test_simhash_proposes_pairs_before_the_keys(spark, monkeypatch):
    near = [(1, 5), (2, 5), (3, 4), (4, 1 << 40), (5, (1 << 40) + 3), (6, -1)]
    prints = spark.createDataFrame(near, "u long, fp long")
    made = {tuple(r) for r in set_similarity.fingerprint_pairs(prints).collect()}
    assert (1, 2) in made and (1, 3) in made and (4, 5) in made and all(a < b for a, b in made) and 6 not in {u for p in made for u in p}

    called = []
    monkeypatch.setattr(set_similarity, "links", lambda fps, *rest: called.append(1) or simhash.links(fps, *rest))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similarity=0.8).collect()} == {1: 1, 2: 1, 3: 3}
    assert called


def test_merged_groups_join_roots_only(spark):
    group = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "u long, root long")
    pairs = spark.createDataFrame([(2, 6), (1, 5), (1, 2), (6, 9), (7, 8)], "a long, b long")
    got = {r.u: r.root for r in set_similarity.merged(group, pairs).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 9: 1, 7: 7, 8: 7}


@pytest.mark.parametrize("link", [True, False])
def test_a_large_group_is_joined_by_a_few_pairs_a_text(spark, link):
    n = 120
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)], "a long, b long")
    seen = []

    def linked(some):
        seen.extend(tuple(r) for r in some.collect())
        return some if link else some.limit(0)

    group, left = set_similarity.joined_by_turns(pairs, spark.createDataFrame([], "u long, root long"), linked)
    rest = [tuple(r) for r in left.collect()]
    if link:
        # All pairs were compared before: 7140 here.
        assert len(seen) + len(rest) < 10 * n
        roots = {r["root"] for r in set_similarity.merged(group, left).collect()}
        assert len(roots) == 1 and group.count() == n
    else:
        assert group.count() == 0 and sorted(seen + rest) == sorted(tuple(r) for r in pairs.collect())


def crowd_of(spark, n, link):
    """Entries of one key, with bitmaps by u, of texts that are all alike or share two thirds of their shingles."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, size=200)
    sets = [np.unique(np.concatenate([base[: 195 if link else 135], rng.integers(0, 2**62, size=5 if link else 65)])) for _ in range(n)]
    crowd = spark.createDataFrame([(9, i, 200, 0) for i in range(n)], "key long, u long, n int, pos int")
    sizes = spark.createDataFrame([(i, 200, set_similarity.parity(x)) for i, x in enumerate(sets)], "u long, n int, bits binary")
    return crowd, sizes, sets


def test_a_crowded_key_is_joined_by_few_pairs_a_text(spark):
    n, seen = 700, []
    crowd, sizes, _ = crowd_of(spark, n, True)

    def linked(pairs):
        seen.append(pairs.count())
        return pairs

    none = spark.createDataFrame([], "u long, root long")
    group, left = set_similarity.crowd_turns(crowd.repartition(3), sizes, none, linked, 0.8)
    rest = set_similarity.crowd_pairs(left, 0.8)
    # All 244 650 pairs of the key were made before.
    assert max(seen) <= n and len(seen) < 12 and sum(seen) + rest.count() < 40 * n
    assert len({r.root for r in set_similarity.merged(group, rest).collect()}) == 1


@pytest.mark.parametrize("cell", [8, 256])
def test_a_crowded_key_leaves_no_pair_out(spark, monkeypatch, cell):
    """Texts in different groups meet in one cell, whatever the cells and groups; only the bitmaps rule pairs out."""
    monkeypatch.setattr(set_similarity, "CELL", cell)
    n = 60
    crowd, sizes, sets = crowd_of(spark, n, True)
    roots = [0 if i % 3 else i for i in range(n)]
    entries = set_similarity.with_maps(crowd.join(spark.createDataFrame(list(enumerate(roots)), "u long, root long"), "u"), sizes)
    made = [tuple(r) for r in set_similarity.crowd_pairs(entries, 0.8).collect()]
    alike = {(i, j) for i in range(n) for j in range(i + 1, n) if roots[i] != roots[j]}
    assert sorted(made) == sorted(alike)
    far, sizes, _ = crowd_of(spark, n, False)
    entries = set_similarity.with_maps(far.withColumn("root", far["u"]), sizes)
    assert set_similarity.crowd_pairs(entries, 0.8).count() == 0
