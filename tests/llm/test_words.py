"""Spelling variants, toxicity and periodic runs: brute force, odd rows, held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import periodic, spelling, toxicity
from corpusflow.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, word string, n long, key long, id long, body string, label int, runs int, score int"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two " * 40), (4, "one two " * 40), (None, "a b c " * 9), (None, None), (5, "中文 " * 7),
    (6, "x" * 70_000), (7, "été " * 30_000), (8, "Straße STRASSE strasse × ÷ ÿÿÿÿÿÿÿ " * 3), (9, "a\x0bb\x1cc d \x0c" * 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "", 0, 0, 0, "", 0, 0, 0) for i, t in ODD], CLASHING).repartition(3)


# -- spelling ---------------------------------------------------------------------


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any((a[i + 1 :] if len(a) == len(b) else a[i:]) == b[i + 1 :] for i in range(len(b)) if a[:i] == b[:i])


def spelled(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    forms, out = {}, {}
    for w in n:
        near = sorted((x for x in n if one_apart(w, x)), key=lambda x: (-n[x], x))
        forms[w] = near[0] if near and n[near[0]] >= 10 * n[w] else None
        out[w] = [forms[w], w, n[w], len(near), n[forms[w]] if forms[w] else None]
    for w in n:
        while forms[out[w][1]]:
            out[w][1] = forms[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("crowd,task_rows,frequent", [(64, 20_000, 4_096), (2, 20_000, 8), (2, 5, 64)])
def test_spelling_against_brute_force(spark, crowd, task_rows, frequent):
    random.seed(crowd + task_rows)
    stems = ["something", "anything", "nothingness", "äußerung", "aaaaaaaa", "abababab", "q" * 40 + "r" * 30, "z" * 300]
    typo = lambda w, i, c: random.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
    words = []
    for stem in stems:
        close = [typo(stem, random.randrange(len(stem)), random.choice("abgz")) for _ in range(25)]
        words += [stem] * 400 + [w for w in close for _ in range(random.choice([1, 3, 30]))]
        words += [typo(w, random.randrange(len(w)), "e") for w in close] * 2
    random.shuffle(words)
    rows = [(i, " ".join(words[i::40]).upper() if i % 2 else "-".join(words[i::40])) for i in range(40)] + [(None, "anything " * 3), (3, None)]
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, task_rows=task_rows, frequent=frequent)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}
    assert got == spelled(rows)
    assert any(v[1] != v[0] and v[0] for v in got.values())  # a chain of two forms at least


def test_spelling_of_odd_rows(spark, odd):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(odd).collect()}
    assert got == spelled(ODD) and spelling.spelling_variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(odd, min_chars=5)


def test_long_texts_are_read_in_parts(monkeypatch):
    import pyarrow as pa

    text = "Größenwahn and understatement, " * 50
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["id", "body"])
    whole = dict(zip(*spelling.counted_words([7], pa.array([text]), 7, 31)))
    monkeypatch.setattr(spelling, "SLICE_BYTES", 64)
    parts = list(spelling.parted(batch))
    counts = Counter()
    for ids, texts in parts:
        counts.update(dict(zip(*spelling.counted_words(ids, texts, 7, 31))))
    assert len(parts) > 10 and counts == whole


def test_no_edit_affects_more_grams_than_the_bound(spark):
    """All but ``affected`` grams of a word are grams of any word one edit away."""
    random.seed(5)
    words = ["".join(random.choice("abc") for _ in range(random.randrange(7, 12))).encode() for _ in range(300)]
    table = spark.createDataFrame([(bytearray(w), 2) for w in set(words)], "word binary, n long")
    grams = spelling.gram_dictionary(table, 16)
    assert {g.bit_length() > 16 for g in grams.grams.tolist()} == {True, False}

    def parts(w):
        d = spelling.Decomposed([w], grams)
        return Counter(zip(d.size.tolist(), d.row.tolist())), int(d.affected[0])

    for w in words[:60]:
        own, bound = parts(w)
        for i in range(len(w)):
            for other in (w[:i] + w[i + 1 :], w[:i] + b"b" + w[i:], w[:i] + b"c" + w[i + 1 :]):
                assert sum((own - parts(other)[0]).values()) <= bound <= 4


# -- toxicity -----------------------------------------------------------------------


def test_toxicity_of_rows_that_were_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.toxicity(docs, toxicity.model_of(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    out = [(known[r.doc_id], r.score, r.predicted) for r in found if r.held_out and r.doc_id in known]
    bad, good = [s for y, s, _ in out if y], [s for y, s, _ in out if not y]
    assert np.mean([b > g for b in bad for g in good]) > 0.93
    assert np.mean([p for y, _, p in out if not y]) < 0.02 and np.mean([p for y, _, p in out if y]) > 0.6


def test_misspellings_share_their_ngrams():
    random.seed(3)
    plain = ["".join(random.choice("aeioulmnrst") for _ in range(random.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(random.choices(plain, k=60)) for _ in range(400)]
    bad = [" ".join(random.choices(plain, k=58) + ["worthless", "pathetic"]) for _ in range(100)]
    model = toxicity.fit(texts + bad, np.array([0] * 400 + [1] * 100))
    score = dict(zip(["worthles", "pathetik", "wortthless"] + plain, model.word_scores(["worthles", "pathetik", "wortthless"] + plain)))
    assert min(score[w] for w in ("worthles", "pathetik", "wortthless")) > np.quantile([score[w] for w in plain], 0.99)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, v) for i in range(12) for v in (0, 1, None, 7)] + [(None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.model_of(odd, labels)
    found = toxicity.toxicity(odd, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == len(ODD)
    one = toxicity.model_of(odd, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.toxicity(odd, one).collect()} == {0}
    nothing = toxicity.model_of(odd.limit(0), labels)
    assert toxicity.toxicity(odd.limit(0), nothing).count() == 0


# -- periodic runs ------------------------------------------------------------------


def all_runs(words, exponent=4, shortest=6):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(shortest, exponent * q):
                if not any(all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    random.seed(seed)
    docs = []
    for _ in range(120):
        k, n, words = random.choice([1, 2, 2, 3, 5]), random.choice([0, 1, 5, 6, 10, 30, 80, 200]), []
        while len(words) < n:
            root = [random.randrange(k) for _ in range(random.choice([1, 2, 3, 4, 5, 7, 8, 9, 11, 15, 16, 17, 31, 33]))]
            words += (root * 6)[: random.randrange(1, 6 * len(root) + 1)]
            if random.random() < 0.3:
                words = words * random.choice([2, 4, 5])
        docs.append(words[:450])
    sizes, codes = np.array([len(d) for d in docs]), np.array([w for d in docs for w in d], dtype=np.int64)
    assert [tuple(r) for r in periodic.runs_of(codes, sizes).tolist()] == [(i, *r) for i, d in enumerate(docs) for r in all_runs(d)]


@pytest.mark.parametrize("scale", [4, 8, 16])
def test_synchronising_sets(scale):
    """Equal contexts are selected alike, and only stretches of short period hold no selected position."""
    random.seed(scale)
    words = [random.randrange(2) for _ in range(600)] + [0, 1, 1] * 60 + [0] * 100 + [random.randrange(3) for _ in range(600)]
    joined = periodic.Joined(np.array(words), np.array([len(words)]))
    chosen = set(periodic.synchronising_set(joined, scale).tolist())
    context = {}
    for i in range(len(words) - 2 * scale + 1):
        assert context.setdefault(tuple(words[i : i + 2 * scale]), i in chosen) == (i in chosen)
    for i in range(len(words) - 3 * scale + 2):
        part = words[i : i + 3 * scale - 1]
        short = any(all(a == b for a, b in zip(part, part[p:])) for p in range(1, scale // 3 + 1))
        assert short == (not chosen & set(range(i, i + scale)))


def test_runs_of_whole_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3_000:
            continue
        runs, r = all_runs(words), got[doc.doc_id]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_runs_of_odd_rows(spark, odd):
    got = periodic.periodic_runs(odd).collect()
    want = Counter((i, len(all_runs(re.findall(r"[^\x20\x09-\x0D]+", t or "")[:500]))) for i, t in ODD if len(t or "") < 50_000)
    assert Counter((r.doc_id, r.n_runs) for r in got if r.doc_id not in (6, 7)) == want
    assert next(tuple(r.runs[0]) for r in got if r.doc_id == 7) == (0, 30_000, 1)
    assert periodic.periodic_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd, exponent=3)


# -- language of texts without a letter -----------------------------------------------


def test_marks_alone_are_no_letters_and_cached_scores_change_nothing(monkeypatch):
    import pyarrow as pa

    from corpusflow.llm import language_id as li

    model = li.Model(["de", "en"], np.random.default_rng(1).random((2, li.BUCKETS)), np.ones((2, len(li.SCRIPT_NAMES))))
    texts = pa.array(["́", "123́", "été words", "", "more words of text", "été"])
    whole = li.label_batch(model, texts)
    assert whole[0][:2] == ["und", "und"] and whole[1][:2] == [0.0, 0.0] and "und" not in (whole[0][2], whole[0][5])
    known = li.WordScores(model)
    monkeypatch.setattr(li, "CACHE", 2)
    parts = [li.label_batch(model, texts.slice(i, 1), known) for i in range(len(texts))]
    assert [p[0][0] for p in parts] == whole[0] and [p[2][0] for p in parts] == whole[2]
    assert np.allclose([p[1][0] for p in parts], whole[1])
