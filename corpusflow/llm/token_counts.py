"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

Texts are cut into pre-tokens that no piece of the vocabulary crosses. The
different pre-tokens of a slice go into a trie (they are visited in sorted
order, so the trie is the stack of the current word's prefixes); the best score
of a prefix is computed once for all words that share it, and each word's count
is stored at its end.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import slices, whole_text, worker_state

# Different pre-tokens whose counts a worker keeps.
CACHE = 300_000
SLICE_BYTES = 8 << 20
SPACE = "▁"  # the mark that stands for a space in the pieces
# Fixed value of the format: an unknown character costs this more than the worst piece.
UNKNOWN_PENALTY = 10.0
# Shift of the rank in the Zipf-Mandelbrot law, and steps of a score. Scores in
# whole steps add up exactly, so that ties do not depend on rounding.
SHIFT = 2.7
STEPS = 1024


def log_probability(rank: float, pieces: int) -> float:
    """Zipf-Mandelbrot log probability of the piece of a rank, in whole steps."""
    norm = math.log((pieces + SHIFT) / SHIFT)
    return -round(STEPS * (math.log(rank + SHIFT) + math.log(norm))) / STEPS


class UnigramCounter:
    """Best segmentations over the pieces of a sentencepiece model file.

    Files of merge vocabularies give ranks (as negative scores), no
    probabilities; a piece's probability follows from its rank.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.children: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        worst = 0.0
        for i in range(model.get_piece_size()):
            if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            # Pre-tokens are cut before a space mark; no piece may hold one later.
            assert SPACE not in piece.lstrip(SPACE), piece
            node = 0
            for char in piece:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.score.append(None)
                node = self.children[node][char]
            self.score[node] = log_probability(-model.get_score(i), model.get_piece_size())
            worst = min(worst, self.score[node])
        self.unknown = worst - UNKNOWN_PENALTY
        self.bytes = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.cut = regex.compile(f"\\n|{SPACE}*[^{SPACE}\\n]+|{SPACE}+")
        self.known: dict[str, tuple[int, float]] = {}

    def learn(self, words: list[str]) -> None:
        """Counts and scores of new pre-tokens, one pass over their trie."""
        children, piece_score = self.children, self.score
        # By depth in the trie: best (score, tokens), and the pieces begun but not ended there.
        best: list[tuple[float, int]] = [(0.0, 0)]
        begun: list[list[tuple[int, float, int]]] = [[(0, 0.0, 0)]]
        before = ""
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], begun[shared + 1 :]
            for char in word[shared:]:
                top, tokens, single = None, 0, False
                open_pieces = []
                last = begun[-1][-1]
                for entry in begun[-1]:  # earliest start first; of equal scores it wins
                    child = children[entry[0]].get(char)
                    if child is None:
                        continue
                    open_pieces.append((child, entry[1], entry[2]))
                    gain = piece_score[child]
                    if gain is not None:
                        single = single or entry is last
                        if top is None or entry[1] + gain > top:
                            top, tokens = entry[1] + gain, entry[2] + 1
                if not single:  # the character alone is no piece
                    score, number = best[-1]
                    if top is None or score + self.unknown > top:
                        top, tokens = score + self.unknown, number + (len(char.encode()) if self.bytes else 1)
                best.append((top, tokens))
                open_pieces.append((0, top, tokens))
                begun.append(open_pieces)
            self.known[word] = (best[-1][1], best[-1][0])
            before = word

    def count(self, texts: list[str]) -> tuple[list[int], list[int], list[float]]:
        """Tokens, pre-tokens and score of each text."""
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        self.learn(list(new))
        known = self.known.__getitem__
        tokens, scores = [], []
        for own in cut:
            pairs = np.array(list(map(known, own)), dtype=np.float64).reshape(-1, 2)
            tokens.append(int(pairs[:, 0].sum()))
            scores.append(float(pairs[:, 1].sum()))
        return tokens, [len(own) for own in cut], scores


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_pretokens, score (log probability).

    A space is put before the text, as the model asks; null and empty texts
    have no tokens. A character without a piece counts as its UTF-8 bytes. Of
    segmentations with equal scores the one with the longer last piece counts.
    Rows of one id and null ids are rows like any other; an empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"))

    def run(batches):
        own = worker_state(f"unigram:{model}", lambda: UnigramCounter(model))
        for batch in slices(batches, 1, SLICE_BYTES):
            tokens, words, scores = own.count(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_tokens", "n_pretokens", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, n_pretokens long, score double")
