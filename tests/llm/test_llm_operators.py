"""The training-data operators against brute force, on odd rows and on the small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import xxhash

from corpusflow.llm import byte_bpe, common, cover_search, exact_dedup, language_id, license_scan, line_dedup, packing, simhash, token_counts, warc, wordbpe
from corpusflow.llm.queries import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORD_FILE = vocabularies.path("word_bpe_49k.json")
BYTE_FILE = vocabularies.path("byte_bpe_50k.tiktoken")
PIECE_FILE = vocabularies.path("piece_bpe_32k.model")

LINE = "this very long line is shared by many documents, Really"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Under the MIT License. " * 3), (5, "Under the MIT License. " * 3),
    (5, "Under the MIT License. " * 3), (None, "no id at all"), (None, None), (6, "中文 текст ελλ é ﬁ 😀 <|endoftext|>"),
    (7, "x" * 5000), (8, "word " * 30_000), (9, f"a\n {LINE} \nb"), (10, f"{LINE.upper()}\nc"), (11, LINE), (12, LINE), (13, LINE + "\n" + LINE),
    (14, "12345 !!! ???"), (15, "apache\nlicense-version: 2 cc/by/nc under the mit licenses"),
]
NAMES = "id long, body string, doc_id long, text string, lang string, fp string, kept string, digest string, lang_pred string, part string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(0, "", i, t, "en", "", "", "", "", "") for i, t in ODD], NAMES).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def body(text):
    return text or ""


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# 1. Licenses


def license_truth(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    starts, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        want = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        starts += hits
        labels |= {label} if hits else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan_equals_brute_force(odd, none, documents):
    for docs in (odd, documents):
        truth = sorted((str(r.doc_id), license_truth(body(r.text))) for r in docs.collect())
        got = license_scan.license_scan(docs).collect()
        assert sorted((str(r.doc_id), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == truth
        for r in got:
            assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert license_scan.license_scan(none).count() == 0


def wordings(parsed):
    """Texts that a rule matches: every branch, options with and without, one sample of each class."""
    found = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(value)]
        elif name == "SUBPATTERN":
            own = wordings(value[3])
        elif name == "BRANCH":
            own = [w for branch in value[1] for w in wordings(branch)]
        elif name == "MAX_REPEAT" and value[:2] == (0, 1):
            own = ["", *wordings(value[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            own = wordings(value[2])
        elif name == "IN":
            own = [chr(v) if str(o) == "LITERAL" else "1" for o, v in value]
        elif name == "ANY":
            own = ["x"]
        else:  # a look ahead takes no characters
            assert name in ("ASSERT", "ASSERT_NOT"), name
            own = [""]
        found = [a + b for a in found for b in own]
    return found


def test_no_license_rule_is_shut_out_by_its_keywords():
    import re._parser

    for rule in license_scan.build_rules():
        for text in wordings(re._parser.parse(rule.pattern.pattern)):
            assert any(f" {k}" in f"{text} " for k in rule.keywords), (rule, text)


def test_license_scan_knows_common_wordings():
    scanner = license_scan.Scanner()
    wanted = {
        "FreeBSD license": "bsd-2-clause", "CreativeML OpenRAIL-M license": "openrail", "OpenRAIL": "openrail",
        "BSD 3-Clause License": "bsd-3-clause", "License: BSD-3-Clause": "bsd-3-clause", "Licensed under MIT": "mit",
        "Apache-2.0": "apache-2", "MIT/X11": "mit", "dual licensed MIT or Apache 2.0": "apache-2,mit",
        f"Neither the name of {'the very long holder ' * 20} nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "the server apache 2.0.64 was used": "", "a mit of leather and a clause": "",
    }
    for text, labels in wanted.items():
        assert scanner.scan(text.encode())[5] == labels, text


def test_license_rules_hold_hundreds_and_suppress():
    scanner = license_scan.Scanner()
    assert len(scanner.rules) > 300
    assert scanner.scan(b"This is licensed under the GNU General Public License, version 3.")[5] == "gpl-3"
    assert scanner.scan(b"SPDX-License-Identifier: LGPL-2.1-or-later")[5] == "lgpl-2.1"
    assert scanner.scan(b"https://creativecommons.org/licenses/by-nc-sa/4.0/")[5] == "cc-by-nc-sa-4.0"


def test_suppression_equals_pairwise_rule():
    rng = random.Random(5)
    for _ in range(200):
        found = list({(a, a + rng.randint(0, 6), rng.choice((1, 2, 3)), rng.randint(0, 4)) for a in (rng.randint(0, 8) for _ in range(12))})

        def inside(d):
            return any(
                o != d and o[0] <= d[0] and o[1] >= d[1] and (o[2], o[1] - o[0], -o[3]) > (d[2], d[1] - d[0], -d[3]) for o in found
            )

        assert sorted(license_scan.suppressed(found)) == sorted(d for d in found if not inside(d))


# 2. Languages


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_language_of_odd_and_mixed_rows(spark, odd, none, documents):
    model = language_id.model_of(documents)
    got = language_id.language_id(odd, model)
    assert sorted(got.columns) == sorted([*odd.columns, "held_out", "score", "n_spans"])
    for r in got.collect():
        has_letter = any(c.isalpha() for c in body(r.text))
        assert (r.lang_pred == "und") == (not has_letter) and r.lang_pred in [*model.languages, "und"]
    assert language_id.language_id(none).count() == 0
    assert {r.lang_pred for r in language_id.language_id(odd, language_id.model_of(none)).collect()} == {"und"}
    texts = {r.lang: r.text for r in documents.where("lang is not null and length(text) > 300").collect()}
    mixed = pa.array([texts["en"] + "\n" + texts["de"]])
    assert language_id.label_batch(model, mixed)[2][0] >= 2


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(9, 3))
    codes, sizes = rng.integers(0, 9, 23), np.array([5, 0, 7, 11])
    label = language_id.viterbi(scores, codes, sizes, 0.7)
    at = 0
    for n in sizes.tolist():
        own, got = codes[at : at + n], label[at : at + n]
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.zeros((1, 0), dtype=int)
        value = lambda p: scores[own, p].sum() - 0.7 * (p[1:] != p[:-1]).sum()
        assert n == 0 or abs(value(got) - max(map(value, paths))) < 1e-9 if n < 8 else True
        at += n


# 3. WARC


def test_warc_round_trip(spark):
    html = ["<p>a</p>\r\n\r\nb", None, "", "é" * 3000, "<p>a</p>\r\n\r\nb", "x"]
    pages = [(i, f"http://www.Example.com/{i % 2}?q=a b\r\nc", h) for i, h in enumerate(html)] + [(6, None, "x"), (None, "::", "x"), (6, None, "x")]
    given = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit(1)).repartition(2)
    got = warc.warc_round_trip(given, records_per_archive=2).collect()
    assert len(got) == len(pages)
    first = defaultdict(list)
    for i, _, h in pages:
        first[body(h)].append(i)
    truth = []
    for i, _, h in pages:
        raw, ids = body(h).encode(), [x for x in first[body(h)] if x is not None]
        head = min(ids)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        truth.append((i, len(raw), digest, "response" if i == head else "revisit", None if i == head else head))
    assert sorted(map(str, truth)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    ordered = sorted(got, key=lambda r: (r.range_no, r.position))
    assert [(r.url_key, r.warc_date) for r in ordered] == sorted((r.url_key, r.warc_date) for r in got)
    assert warc.warc_round_trip(given.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        merged = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert merged == sorted(x for run in runs for x in run)


# 4. Byte-level BPE


def test_byte_bpe_equals_library(odd, none, documents):
    import tiktoken

    ranks = byte_bpe.read_ranks(BYTE_FILE)
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, documents):
        truth = []
        for r in docs.collect():
            ids = library.encode_ordinary(body(r.text))
            shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            truth.append((str(r.doc_id), len(ids), shown, hashlib.sha256(body(r.text).encode()).hexdigest(), True))
        got = byte_bpe.encode_decode(docs, BYTE_FILE, vocabularies.PATTERN)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(truth)
    assert byte_bpe.encode_decode(none, BYTE_FILE, vocabularies.PATTERN).count() == 0


def test_byte_bpe_fuzz_and_stream():
    import tiktoken

    own = byte_bpe.Codec(BYTE_FILE, vocabularies.PATTERN)
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    rng = random.Random(2)
    letters = "aabbcZÉé 's't\t\n\r\x0b\x85\xa0<|>12'ªßİı😀中ΣΑ _-!!ﬁẛ̣ the and ing tion"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["a" * 2000, " " * 300, "ab" * 400]
    ids, _ = own.encode(texts)
    for text, found in zip(texts, ids):
        assert found.tolist() == library.encode_ordinary(text)
        assert own.decode(found, block=3) == (text.encode(), True)
    cut = own.encode(["é"])[0][0]
    half = own.decoder.stream()
    assert half.feed(np.array([own.transducer.ranks[b"\xc3"]])) == b"" and half.close() == (b"\xc3", False) and len(cut) == 1


# 5. Packing


def test_packing_is_whole_and_tight(spark, odd, none, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_FILE)
    for docs in (odd, documents):
        truth = []
        for r in docs.collect():
            ids = np.array([*library.encode(body(r.text), add_special_tokens=False).ids, 1], dtype="<u4")
            for piece, start in enumerate(range(0, len(ids), 4096)):
                part = ids[start : start + 4096]
                truth.append((str(r.doc_id), piece, start, len(part), zlib.crc32(part.tobytes())))
        got = packing.pack(docs, WORD_FILE).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(truth)
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for own in held.values():
            own.sort()
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 4096
        assert len(held) <= -(-sum(r.length for r in got) // 4096) * 1.02 + 1
    assert packing.pack(none, WORD_FILE).count() == 0


def test_pack_plan_covers_the_histogram():
    rng = random.Random(4)
    for n in (1, 3, 60, 400):
        histogram = defaultdict(int)
        for _ in range(n):
            histogram[rng.choice((1, 2, 50, rng.randint(1, 4096), 4096))] += rng.randint(1, 500)
        used = defaultdict(int)
        for content, times in packing.pack_plan(dict(histogram)):
            assert sum(content) <= 4096
            for length in content:
                used[length] += times
        assert used == histogram
    assert packing.pack_plan({}) == []


def test_word_ids_equal_library():
    own = wordbpe.WordTokenizer(WORD_FILE)
    rng = random.Random(1)
    parts = [*"aabbcZÉé 's't\t\n\x0b\x1c\x85\xa0<|>12'ªßİıǅ́Å😀中ΣΑ _-!!ﬁẛ̣", "<|endoftext|>", "<|startoftext|>", "'ll", "the", "\x00", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    ids, number = own.encode(pa.array(texts))
    assert np.split(ids, np.cumsum(number)[:-1])[0].tolist() == own.library.encode(texts[0], add_special_tokens=False).ids
    at = 0
    for text, n in zip(texts, number.tolist()):
        assert ids[at : at + n].tolist() == own.library.encode(text, add_special_tokens=False).ids, text
        at += n


def test_words_met_again_are_not_cut_again(monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE", 30)
    own, cut = wordbpe.WordTokenizer(WORD_FILE), []
    parts = own.parts
    monkeypatch.setattr(own, "parts", lambda words: cut.append(list(words)) or parts(words))
    for n in range(40):  # the words of a slice are forgotten, but for those of every slice
        texts = [f"The  word x{n}y{m}, <|endoftext|>'{n} {'z' * m} 中{n}" for m in range(4)] + [None, ""]
        ids, number = own.encode(pa.array(texts))
        truth = [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for t in truth for i in t] and number.tolist() == [len(t) for t in truth]
        assert len(own.index) < 60
    assert [sum("word" in words for words in cut), sum(f"x{n}y1," in words for words in cut)] == [1, 1]


# 6. Lines


def lines_truth(rows):
    keys = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    count, last = defaultdict(int), {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for key in {keys(x) for x in body(t).split("\n")}:
            if len(key) >= 40:
                count[key] += 1
                last[key] = max(last.get(key, order(None)), order(i))
    out = []
    for i, t in rows:
        lines = body(t).split("\n")
        kept = [x for x in lines if not (count[keys(x)] >= 5 and order(i) < last[keys(x)])]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shipped", [1 << 27, 64])
def test_line_dedup_equals_brute_force(odd, none, documents, shipped):
    for docs in (odd, documents):
        got = line_dedup.line_dedup(docs, shipped_bytes=shipped).collect()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == lines_truth(rows)
    assert line_dedup.line_dedup(none, shipped_bytes=shipped).count() == 0


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 3000):
        h = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        row = line_dedup.shard_arrays(h[0], h[1], np.arange(n), np.arange(n) + 5)
        table = line_dedup.LineTable([{"shard": 0, **row}], 1)
        found, counts, lasts = table.probe(h.T.copy())
        assert found.all() and counts.tolist() == list(range(n)) and lasts.tolist() == list(range(5, n + 5)) and len(table.prints) == n
        assert not table.probe(rng.integers(0, 1 << 63, (500, 2), dtype=np.uint64))[0].any()


# 7. Token counts


def test_token_counts_equal_best_segmentation(odd, none):
    own = token_counts.UnigramCounter(PIECE_FILE)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    pieces = {
        model.id_to_piece(i): token_counts.log_probability(-model.get_score(i), 32_000)
        for i in range(32_000)
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))
    }

    def best(text):
        text = "▁" + text.replace(" ", "▁") if text else ""
        top = [(0.0, 0)]
        for i in range(1, len(text) + 1):
            ways = []
            for j in range(max(0, i - 20), i):
                if text[j:i] in pieces:
                    ways.append((top[j][0] + pieces[text[j:i]], -j, top[j][1] + 1))
            if text[i - 1] not in pieces:
                ways.append((top[i - 1][0] + own.unknown, -(i - 1), top[i - 1][1] + len(text[i - 1].encode())))
            score, _, number = max(ways)
            top.append((score, number))
        return top[-1][1]

    rng = random.Random(6)
    letters = "aabbcZÉé 's\t\n12'ªß😀中ΣΑ _-!ẛ̣▁ the and ing tion"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "  ", "a" * 100]
    assert own.count(texts)[0] == [best(t) for t in texts]
    got = {str(r.doc_id): r.n_tokens for r in token_counts.token_counts(odd.where("doc_id between 1 and 6 or doc_id > 8"), PIECE_FILE).collect()}
    assert got["1"] == got["2"] == 0 and got["6"] == best(dict(ODD[:9])[6])
    assert token_counts.token_counts(none, PIECE_FILE).count() == 0


# 8. Best products


def products_truth(rows, k, every):
    whole = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole[n] = (i, [int(np.floor(1024 * x)) for x in v])
    out = []
    for q in sorted({i for i, _ in whole.values() if i % every == 0}):
        own = next(v for i, v in whole.values() if i == q)
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole.values() if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.05).tolist()) for i in range(700)]
    rows += [(1000 + i, base[3].tolist()) for i in range(60)]  # one very common vector
    rows += [(2000, None), (2100, [None] * 8), (2200, [float("nan")] * 8), (None, base[0].tolist()), (2300, [1.0, 2.0]), (2301, [0.5, 2.0]), (2400, [])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).repartition(4)
    got = sorted(map(tuple, cover_search.top_products(given, every=50, query_block=5).collect()))
    assert got == sorted(products_truth(rows, 10, 50))
    assert cover_search.top_products(given.limit(0)).count() == 0


def test_dual_tree_skips_pairs():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 16)) * 1000
    points = np.floor(np.repeat(centers, 100, axis=0) + rng.normal(size=(4000, 16)) * 5)
    search = cover_search.Search(np.arange(0, 4000, 50), points[::50], 5)
    search.add(np.arange(4000), points)
    assert search.compared < 0.5 * 80 * 4000
    scores = points[::50] @ points.T
    scores[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(4000), scores.shape), -scores), axis=1)[:, :5]
    assert np.array_equal(search.best.ids, order)


# 9. SimHash


def fingerprint_truth(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_truth(values, ids, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(values))]


def test_simhash_equals_brute_force(odd, none, documents):
    for docs in (odd, documents):
        got = simhash.near_duplicates(docs).collect()
        rows = docs.collect()
        values = [fingerprint_truth(body(r.text)) for r in rows]
        truth = zip(rows, values, groups_truth(values, [r.doc_id for r in rows], 2))
        assert sorted(str((r.doc_id, r.fp & (2**64 - 1), r.component_id)) for r in got) == sorted(str((r.doc_id, v, c)) for r, v, c in truth)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("distance, parts, bucket", [(2, 3, 256), (2, 3, 4), (3, 4, 8), (8, 3, 256), (5, 4, 256)])
def test_links_connect_like_brute_force(spark, distance, parts, bucket):
    rng = random.Random(distance * 10 + bucket)
    values = set()
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(20):
            values.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 1))))
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), distance, parts, bucket)
    for r in edges.collect():
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= distance
    root = {r.fp & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
    truth = groups_truth(values, list(range(len(values))), distance)
    together, apart = defaultdict(set), defaultdict(set)
    for i, v in enumerate(values):
        together[truth[i]].add(v)
        apart[root.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, apart.values()))


def test_near_copies_are_verified(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)]
    near = [" ".join(w if k != 150 else "changed" for k, w in enumerate(t.split())) for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 8, shingle=2, similarity=0.8).collect()}
    assert sum(got[30 + i] == i for i in range(10)) >= 9 and all(got[i] == i for i in range(30))


# 10. Exact copies


def weak(text):
    return F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))


@pytest.mark.parametrize("digest, split", [(exact_dedup.sha256, None), (weak, None), (weak, "doc_id % 2 = 0"), (exact_dedup.sha256, "true")])
def test_exact_dedup_equals_brute_force(odd, documents, digest, split):
    for docs in (odd, documents.limit(150)) if split is None else (odd,):
        rows = [(r.doc_id, body(r.text)) for r in docs.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        order = lambda i: -(1 << 63) if i is None else i
        truth = [(i, max(groups[t], key=order), len(groups[t])) for i, t in rows]
        is_new = None if split is None else F.expr(split)
        got = exact_dedup.exact_dedup(docs, is_new, digest=digest).collect()
        assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == sorted(map(str, truth))
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 100, 20_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        found = exact_dedup.build_filter(keys)
        assert exact_dedup.may_contain(keys, *found).all()
        assert exact_dedup.may_contain(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), *found).mean() < 0.01


def test_worker_state_is_kept_until_it_is_forgotten():
    made = []
    make = lambda: made.append(1) or len(made)
    common.forget_worker_state()
    assert [common.worker_state("a", make), common.worker_state("a", make), common.worker_state("b", make)] == [1, 1, 2]
    common.forget_worker_state()
    common.forget_worker_state()
    assert common.worker_state("a", make) == 3
    common.forget_worker_state()
