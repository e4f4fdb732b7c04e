"""Toxicity of whole texts by averaged subword embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed) and of the
word itself; a passage is the mean of its words; a softmax over two classes reads
the passage. Vectors and softmax are trained together in numpy (Joulin et al.,
2017, "Bag of tricks"; Bojanowski et al., 2017). A misspelling that was never seen
shares most n-grams with the word it comes from. A document is as toxic as its
worst passage, so length does not thin it out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import mix64, ragged, released, slices, whole_text
from corpusflow.session import staged

# The model is fitted on about so many labelled rows of each class, chosen by a
# hash of their id, and on so many passages of each row at most.
TRAIN_ROWS = {0: 4_000, 1: 1_200}
TRAIN_PASSAGES = 2
PASSAGE_WORDS = 128  # at most; a text is cut evenly
PRIOR_WORDS = 16  # words that say nothing, added to each mean: a few words are no proof
PIECE_CHARS = 64  # longer words are read in pieces
SIZES = (3, 4, 5)  # n-grams, word marks included
BUCKETS = 1 << 18
DIM = 8
LEAST = 5  # words a subword must be met in
FLOOR = 3.0  # of the first steps' size: rare subwords take no larger steps than these
EPOCHS = 4  # more where these make fewer than UPDATES steps
UPDATES = 300
BATCH = 128
RATE = 1.0
DECAY = 0.0005
SEED = 13
THRESHOLD = 0.7
SLICE_BYTES = 2 << 20

_LONG_PIECE = r"([^\s]{%d})" % PIECE_CHARS
_NOT_WORD = r"[^\p{L}\p{M}\p{N}\s]+"


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word number of every word, the different words, and words per text.

    Words are lower-cased and hold letters, marks and digits only.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), _NOT_WORD, "")
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _LONG_PIECE, r"\1 "))
    flat, ends = split.flatten(), split.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    inner = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), np.diff(inner[ends - ends[0]])


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of every word and of the words themselves."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(flat))
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    buckets, numbers = [], []
    with np.errstate(over="ignore"):
        prime = np.uint64(0x9E3779B97F4A7C15)
        rolling = flat
        for n in range(2, SIZES[-1] + 1):
            rolling = rolling[:-1] * prime + flat[n - 1 :]
            if n in SIZES:
                inside = np.flatnonzero(left[: len(rolling)] >= n)
                buckets.append(mix64(rolling[inside], n) >> shift)
                numbers.append(word[inside])
        powers = np.cumprod(np.full(PIECE_CHARS + 3, prime))
        place = np.minimum(ragged(sizes), len(powers) - 1)
        whole = np.add.reduceat(flat * powers[place], np.cumsum(sizes) - sizes)
        buckets.append(mix64(whole, 99) >> shift)
        numbers.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(numbers)


def passages(sizes: np.ndarray, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(words of each passage, its text): texts cut evenly into as few passages as hold them."""
    parts = -(-sizes // words)
    text = np.repeat(np.arange(len(sizes)), parts)
    nth = ragged(parts)
    cut = lambda i: i * sizes[text] // parts[text]
    return cut(nth + 1) - cut(nth), text


def bags(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words of each passage, one passage after another, and how many there are.

    A word that fills a passage says no more than once.
    """
    passage = np.repeat(np.arange(len(lengths)), lengths)
    both = np.unique(passage << 32 | codes)
    return both & 0xFFFFFFFF, np.bincount(both >> 32, minlength=len(lengths))


class Model:
    """What one subword adds to the log odds of its word, and the odds of nothing."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def word_scores(self, words: list[str]) -> np.ndarray:
        buckets, numbers = subwords(words)
        return np.bincount(numbers, self.weights[buckets]) / np.bincount(numbers)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text: that of its worst passage; of no words, that of nothing."""
        codes, different, sizes = coded_words(texts)
        out = np.full(len(texts), self.bias)
        if different:
            lengths, text = passages(sizes)
            words, n = bags(codes, lengths)
            sums = segment_sums(self.word_scores(different)[words], n)
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, text, sums / (n + PRIOR_WORDS) + self.bias)
            out = np.where(sizes > 0, worst, out)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many rows each; every size is one at least."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0)


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, sizes, different row numbers), so that sums over equal rows are sums of segments."""
    order = np.argsort(rows, kind="stable")
    found, sizes = np.unique(rows[order], return_counts=True)
    return order.astype(np.int32), sizes, found


class Batch:
    """Some passages as index arrays: which words they hold, and which subwords those hold."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, first: np.ndarray, parts: np.ndarray, buckets: np.ndarray) -> None:
        self.n = sizes[rows]
        used, local = np.unique(codes[np.repeat(starts[rows], self.n) + ragged(self.n)], return_inverse=True)
        self.local = local.astype(np.int32)
        self.k = parts[used]
        bucket = buckets[np.repeat(first[used], self.k) + ragged(self.k)]
        self.bucket = bucket.astype(np.int32)
        self.by_word = grouped(self.local)
        self.by_bucket = grouped(self.bucket)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Vectors and softmax trained together by Adagrad.

    Subwords met in fewer than LEAST words teach nothing about others and have no
    vector. With one class only, or none, nothing can be learned and every text
    gets the same odds.
    """
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 6.0 if len(labels) and labels[0] else -6.0)
    codes, different, sizes = coded_words(pa.array(texts, pa.string()))
    some = sizes > 0
    labels = labels[some]
    codes, sizes = bags(codes, sizes[some])
    starts = np.cumsum(sizes) - sizes
    buckets, numbers = subwords(different)
    order = np.argsort(numbers, kind="stable")
    buckets = buckets[order]
    parts = np.bincount(numbers)
    first = np.cumsum(parts) - parts
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(labels))
    batches = [(rows := shuffled[a : a + BATCH], Batch(rows, starts, sizes, codes, first, parts, buckets)) for a in range(0, len(shuffled), BATCH)]
    # A word counts once for each passage of a batch that holds it, LEAST times at most.
    often = np.zeros(BUCKETS, dtype=np.int64)
    for _, b in batches:
        often += np.bincount(b.bucket, np.repeat(np.minimum(b.by_word[1], LEAST), b.k), minlength=BUCKETS).astype(np.int64)
    known = often >= LEAST
    vectors = (rng.uniform(-0.1 / DIM, 0.1 / DIM, (BUCKETS, DIM)) * known[:, None]).astype(np.float32)
    softmax, bias = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2)
    vectors_seen, softmax_seen, bias_seen = np.full(BUCKETS, 1e-8, dtype=np.float32), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    floor = None
    for _ in range(max(epochs, -(-UPDATES // len(batches)))):
        for i in rng.permutation(len(batches)).tolist():
            rows, b = batches[i]
            word = segment_sums(vectors[b.bucket], b.k) / b.k[:, None].astype(np.float32)
            mean = segment_sums(word[b.local], b.n) / (b.n[:, None] + PRIOR_WORDS).astype(np.float32)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            error = p / len(rows)
            back = (error @ softmax.T / (b.n[:, None] + PRIOR_WORDS)).astype(np.float32)
            order, size, _ = b.by_word
            of_word = segment_sums(np.repeat(back, b.n, axis=0)[order], size) / b.k[:, None].astype(np.float32)
            order, size, touched = b.by_bucket
            change = segment_sums(np.repeat(of_word, b.k, axis=0)[order], size)
            step = mean.T @ error
            size = (change**2).mean(axis=1)
            if floor is None:
                floor = FLOOR * float(np.quantile(size, 0.999))
                vectors_seen[:] = floor
            vectors_seen[touched] += size
            vectors[touched] *= 1 - DECAY
            vectors[touched] -= RATE * change / np.sqrt(vectors_seen[touched])[:, None] * known[touched][:, None]
            softmax_seen += step**2
            softmax -= (RATE * step / np.sqrt(softmax_seen)).astype(np.float32)
            total = error.sum(axis=0)
            bias_seen += total**2
            bias -= RATE * total / np.sqrt(bias_seen)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_column: str = "doc_id") -> Column:
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_passages(docs: DataFrame, id_column: str, text: str | Column, labels: DataFrame, label: str, rows: dict[int, int]) -> DataFrame:
    """(id, label, nth, passage) of about so many labelled documents of each class."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"), held_out(id_column).alias("out"))
    known = known.where("id is not null and label in (0, 1) and not out").groupBy("id").agg(F.max("label").alias("label"))
    body = F.col(text) if isinstance(text, str) else text
    keyed = docs.select(F.col(id_column).alias("id"), body.alias("body")).where("body is not null")
    present = staged(known.join(keyed.select("id").distinct(), "id", "left_semi"))
    counts = {r["label"]: r["count"] for r in present.groupBy("label").count().collect()}  # two rows at most
    steps = 1 << 20
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, math.ceil(steps * min(1.0, rows[value] / n))).otherwise(share)
    chosen = present.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < share)  # about as many ids as ``rows`` names

    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            codes, different, sizes = coded_words(batch.column(1))
            if not different:
                continue
            lengths, row = passages(sizes)
            ends = np.cumsum(lengths)
            parts = np.bincount(row, minlength=len(sizes))
            nth = ragged(parts)
            # Evenly spaced passages of a longer text.
            keep = np.minimum(parts, TRAIN_PASSAGES)[row]
            taken = np.flatnonzero(nth * keep // parts[row] != (nth - 1) * keep // parts[row])
            texts = [" ".join([different[c] for c in codes[ends[i] - lengths[i] : ends[i]].tolist()]) for i in taken.tolist()]
            take = pa.array(row[taken])
            columns = [batch.column(0).take(take), batch.column(2).take(take), pa.array(nth[taken].astype(np.int64)), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "nth", "passage"])

    kind = keyed.schema["id"].dataType.simpleString()
    picked = keyed.join(F.broadcast(chosen), "id").select("id", "body", "label")
    return picked.mapInArrow(run, f"id {kind}, label int, nth long, passage string")


def model_of(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str | Column = "text", rows: dict[int, int] = TRAIN_ROWS
) -> Model:
    """The model of the labelled documents that are not held out."""
    found = training_passages(docs, id_column, text, labels, label, rows).toArrow()  # bounded: rows, passages, words, letters
    found = found.sort_by([("id", "ascending"), ("nth", "ascending"), ("passage", "ascending")])
    return fit(found["passage"].to_pylist(), found["label"].to_numpy().astype(np.int64))


def toxicity(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text: str | Column = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    ``score`` is the probability of label 1 for the worst passage of the whole
    text. Null and empty texts, and texts without a letter or digit, get the
    odds of an empty passage. Null ids are not held out. Rows of one id are rows
    like any other; an empty table gives an empty result; labels of ids without
    a document, null labels and other values are not learned from, and an id
    with both labels counts as 1. If only one class can be learned from, all
    texts are given to it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS numbers
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"), held_out(id_column).alias("out"))

    def run(batches):
        fitted = Model(*shipped.value)
        for batch in slices(batches, 1, SLICE_BYTES):
            scores = fitted.scores(batch.column(1))
            columns = [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "held_out", "score", "predicted"])
        released()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, score double, predicted int")
