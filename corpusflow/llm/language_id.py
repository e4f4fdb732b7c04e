"""Language identification of whole texts, span by span.

The script of a word's letters narrows the candidate languages; character
n-grams score the word under each of them; a Viterbi pass over the words, with
a penalty for every change of language, labels the spans of a mixed text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import forget_worker_state, slices, whole_text
from corpusflow.session import staged

# About so many labelled rows of each language are learned from, chosen by a
# hash of their id.
TRAIN_ROWS = 4_000
BUCKETS = 1 << 15  # hashed features
SMOOTHING = 0.3
TEMPER = 0.5  # n-grams of one word are not independent
WORST = -12.0  # how far a word may speak against a language
OTHER_SCRIPT = -30.0
SWITCH = 9.0  # cost of a change of language
RARE_SCRIPT = 0.005  # share of letters below which a script does not belong to a language
SLICE_BYTES = 1 << 20
# Different words whose scores a task keeps.
CACHE = 100_000
UNKNOWN = "und"

# First code points of script blocks, in order; "" ends a block.
SCRIPTS = """
0041 latin, 0370 greek, 0400 cyrillic, 0530 armenian, 0590 hebrew, 0600 arabic, 0700 syriac, 0750 arabic, 0780 thaana,
07C0 nko, 0800 other, 08A0 arabic, 0900 devanagari, 0980 bengali, 0A00 gurmukhi, 0A80 gujarati, 0B00 oriya, 0B80 tamil, 0C00 telugu,
0C80 kannada, 0D00 malayalam, 0D80 sinhala, 0E00 thai, 0E80 lao, 0F00 tibetan, 1000 myanmar, 10A0 georgian, 1100 hangul,
1200 ethiopic, 13A0 other, 1780 khmer, 1800 mongolian, 18B0 other, 1C80 cyrillic, 1C90 georgian, 1CC0 other, 1D00 latin,
1F00 greek, 2000 other, 2C60 latin, 2C80 other, 2D00 georgian, 2D30 other, 2DE0 cyrillic, 2E00 other, 2E80 han, 3040 kana, 3100 han,
3130 hangul, 3190 han, 31F0 kana, 3200 other, 3400 han, A000 other, A640 cyrillic, A6A0 other, A720 latin, A800 other, A960 hangul,
A980 other, AB30 latin, AB70 other, AC00 hangul, D800 other, F900 han, FB00 latin, FB13 armenian, FB1D hebrew, FB50 arabic, FE00 other,
FE70 arabic, FF00 latin, FF65 kana, FFA0 hangul, FFE0 other, 20000 han, 323B0 other
"""
_BLOCKS = [entry.split() for entry in SCRIPTS.replace("\n", " ").split(",")]
SCRIPT_STARTS = np.array([int(start, 16) for start, _ in _BLOCKS])
SCRIPT_NAMES = sorted({name for _, name in _BLOCKS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in _BLOCKS])

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}\n]+")
_LETTER = regex.compile(r"\p{L}")
BREAK = 10


class Words:
    """The different words of a batch: letters, scripts, and hashed features.

    A word is a run between ASCII white space; only its letters count, lower-cased.
    """

    def __init__(self, different: list[str]) -> None:
        joined = _NOT_LETTERS.sub("", "\n" + "\n".join(different).lower() + "\n")
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        edge = code == BREAK
        self.n = len(different)
        word = np.cumsum(edge) - 1  # of the word that begins after, or goes on at, a position
        letter = ~edge
        # Marks are read with their word, but a word of marks alone has no letter.
        own = np.array([bool(_LETTER.search(w)) for w in different])
        self.letters = np.bincount(word[letter], minlength=self.n)[: self.n] * own
        # Script of each word: that of most of its letters.
        script = SCRIPT_OF[np.maximum(np.searchsorted(SCRIPT_STARTS, code[letter].astype(np.int64), side="right") - 1, 0)]
        table = np.bincount(word[letter] * len(SCRIPT_NAMES) + script, minlength=self.n * len(SCRIPT_NAMES))
        table = table.reshape(-1, len(SCRIPT_NAMES))[: self.n]
        self.script, self.scripts = table.argmax(axis=1), table
        # Features: n-grams of one to three characters with word borders, and the word itself.
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            prime = np.uint64(0x9E3779B97F4A7C15)
            rolling = code * prime
            self._add(rolling[letter], word[letter], 1)
            two = (rolling[:-1] ^ (rolling[:-1] >> np.uint64(29))) * prime + rolling[1:]
            inner = letter[:-1] | letter[1:]
            self._add(two[inner], word[:-1][inner], 2)
            if len(code) > 2:
                three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * prime + rolling[2:]
                inner = letter[1:-1]
                self._add(three[inner], word[:-2][inner], 3)
            # Each word as a sum of its letters times powers of a number by their place.
            place = np.arange(len(code)) - np.flatnonzero(edge)[np.minimum(word, edge.sum() - 1)]
            powers = prime ** (place % 64).astype(np.uint64)
            whole = np.zeros(self.n + 1, dtype=np.uint64)
            np.add.at(whole, word[letter], rolling[letter] * powers[letter])
        some = np.flatnonzero(self.letters)
        self._add(whole[some], some, 4)

    def _add(self, keys: np.ndarray, words: np.ndarray, kind: int) -> None:
        with np.errstate(over="ignore"):
            mixed = (keys + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
        bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
        # A border gram belongs to the word after the border, or before it at the end.
        self.parts.append((bucket, np.minimum(words, self.n - 1).astype(np.int32)))

    def totals(self, weight: np.ndarray) -> np.ndarray:
        """Features of all words, each word ``weight`` times."""
        out = np.zeros(BUCKETS)
        for bucket, word in self.parts:
            out += np.bincount(bucket, weights=weight[word], minlength=BUCKETS)
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of feature ``values`` per word."""
        out = np.zeros(self.n)
        for bucket, word in self.parts:
            out += np.bincount(word, weights=values[bucket], minlength=self.n)
        return out


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word number of every word, the different words, and words per text."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.diff(split.offsets.to_numpy())


class Model:
    """Log probabilities of features and the scripts of each language."""

    def __init__(self, languages: list[str], features: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        smooth = features + SMOOTHING
        self.values = np.log(smooth / smooth.sum(axis=1, keepdims=True)) * TEMPER
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = share >= RARE_SCRIPT
        self.allowed[:, ~self.allowed.any(axis=0)] = True  # a script nobody uses says nothing

    def word_scores(self, words: Words) -> np.ndarray:
        """Words x languages, best language 0."""
        scores = np.stack([words.sums(v) for v in self.values], axis=1)
        fits = self.allowed[:, words.script].T
        scores = np.where(fits, scores, -np.inf)
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.maximum(scores, np.where(fits, WORST, OTHER_SCRIPT))
        scores[words.letters == 0] = 0
        return scores


def viterbi(scores: np.ndarray, codes: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language index of every word; ``sizes`` words belong to each text. All texts step together."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    n_lang = scores.shape[1]
    best = np.zeros((len(sizes), n_lang))
    origin = np.zeros(len(codes), dtype=np.int16)
    stays = np.ones((len(codes), n_lang), dtype=bool)
    longest = int(lengths[0]) if len(lengths) else 0
    # Texts still running at step t are the first ones.
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        k = int(active[t])
        at = starts[:k] + t
        now = best[:k]
        top = now.argmax(axis=1)
        changed = now[np.arange(k), top] - switch
        stay = now >= changed[:, None]
        origin[at], stays[at] = top, stay
        best[:k] = np.where(stay, now, changed[:, None]) + scores[codes[at]]
    label = np.zeros(len(codes), dtype=np.int16)
    current = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = int(active[t])
        at = starts[:k] + t
        own = current[:k]
        label[at] = own
        current[:k] = np.where(stays[at, own], own, origin[at])
    return label


def train(labelled: DataFrame, rows_per_language: int = TRAIN_ROWS) -> Model:
    """A model from rows (id, body, lang); about ``rows_per_language`` rows of each language are read."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPT_NAMES))))
    steps = 1 << 20
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, math.ceil(steps * min(1.0, rows_per_language / counts[lang])))))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < share[F.col("lang")]).select("lang", "body")

    def run(batches):
        forget_worker_state()
        totals = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
        for batch in slices(batches, 1, SLICE_BYTES):
            codes, different, sizes = coded_words(batch.column(1))
            if not different:
                continue
            words = Words(different)
            row_lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
            of_word = np.repeat(row_lang, sizes)
            for i in np.unique(of_word).tolist():
                weight = np.bincount(codes[of_word == i], minlength=words.n).astype(float)
                totals[i, :BUCKETS] += words.totals(weight)
                totals[i, BUCKETS:] += weight @ words.scripts
        lang, feature = np.nonzero(totals)
        columns = [pa.array(lang, pa.int32()), pa.array(feature, pa.int32()), pa.array(totals[lang, feature])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "feature", "n"])

    found = sample.mapInArrow(run, "lang int, feature int, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    rows = staged(found).toArrow()  # at most languages x (buckets + scripts) rows
    totals = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    totals[rows["lang"].to_numpy(), rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, totals[:, :BUCKETS], totals[:, BUCKETS:])


class WordScores:
    """Scores and letters of the words met so far; a cache that starts afresh beyond its bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, dtype=np.int64)

    def rows(self, different: list[str]) -> np.ndarray:
        """Row of each word, those that are new included."""
        if len(self.index) > CACHE:
            self.clear()
        new = [w for w in different if w not in self.index]
        if new:
            words = Words(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.word_scores(words)])
            self.letters = np.concatenate([self.letters, words.letters])
        return np.fromiter(map(self.index.__getitem__, different), dtype=np.int64, count=len(different))


def label_batch(model: Model, texts: pa.Array, known: WordScores | None = None) -> tuple[list[str], list[float], list[int]]:
    """Language, share of letters in it, and number of spans of each text."""
    n = len(texts)
    codes, different, sizes = coded_words(texts)
    if not different or not model.languages:
        return [UNKNOWN] * n, [0.0] * n, [0] * n
    known = known or WordScores(model)
    codes = known.rows(different)[codes]
    label = viterbi(known.scores, codes, sizes)
    text = np.repeat(np.arange(n), sizes)
    letters = known.letters[codes]
    n_lang = len(model.languages)
    share = np.bincount(text * n_lang + label, weights=letters, minlength=n * n_lang).reshape(n, n_lang)
    total = share.sum(axis=1)
    top = share.argmax(axis=1)
    spoken = np.flatnonzero(letters)
    fresh = np.ones(len(spoken), dtype=bool)
    if len(spoken):
        fresh[1:] = (label[spoken][1:] != label[spoken][:-1]) | (text[spoken][1:] != text[spoken][:-1])
    spans = np.bincount(text[spoken][fresh], minlength=n)
    some = total > 0
    names = [model.languages[k] if s else UNKNOWN for k, s in zip(top.tolist(), some.tolist())]
    sure = np.where(some, share[np.arange(n), top] / np.maximum(total, 1), 0.0)
    return names, sure.tolist(), spans.tolist()


def held_out(id_column: str = "doc_id") -> Column:
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model_of(docs: DataFrame, id_column: str = "doc_id", text: str | Column = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows of ``docs`` that are not held out."""
    body = F.col(text) if isinstance(text, str) else text
    known = docs.select(F.col(id_column).alias("id"), body.alias("body"), F.col(lang).alias("lang"), held_out(id_column).alias("out"))
    return train(known.where("id is not null and body is not null and lang is not null and not out"), rows)


def language_id(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """``docs`` with held_out, lang_pred, score and n_spans; columns of those names are replaced.

    ``lang_pred`` is the language of most letters along the best path, ``und``
    when the text is null or has no letter (or nothing could be learned), and
    ``score`` is its share of the letters. Of equal shares the language that
    comes first by name. Null ids are not held out and not learned from; rows
    of one id are rows like any other; an empty table gives an empty result.
    """
    model = model if model is not None else model_of(docs, id_column, text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers
    added = ("held_out", "lang_pred", "score", "n_spans")
    kept = [c for c in docs.columns if c not in added]
    rows = docs.withColumns({"held_out": held_out(id_column), "_body": whole_text(text)}).select("held_out", "_body", *kept)

    def run(batches):
        forget_worker_state()
        known = WordScores(shipped.value)
        for batch in slices(batches, 1, SLICE_BYTES):
            names, sure, spans = label_batch(shipped.value, batch.column(1), known)
            columns = [*batch.columns[2:], batch.column(0), pa.array(names), pa.array(sure), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    schema = rows.select(*kept).schema
    for name, kind in zip(added, ("boolean", "string", "double", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
