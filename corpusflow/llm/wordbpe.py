"""Ids of the lower-casing word BPE vocabulary, for whole Arrow columns.

White space never joins two tokens of this vocabulary, so texts are cut at
ASCII white space, each different word is encoded once and remembered, and the
ids are put together by index arithmetic. Plain words are merged many at a time;
words with special tokens, rare scripts or great length go to the tokenizers
library.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from corpusflow.llm.common import ragged, worker_state

# Different words whose ids a worker keeps, and ids of all of them.
CACHE = 400_000
CACHED_IDS = 8 * CACHE
# Longer parts go to the library, whose merging does not grow with the square.
LONGEST = 64
NEVER = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies give each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """Encodes batches of texts with the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        model, vocab = spec["model"], spec["model"]["vocab"]
        # The rules above hold for this family of vocabularies only.
        assert model["end_of_word_suffix"] == "</w>" and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cutter = regex.compile(self.pattern.pattern + r"|\n")
        self.plain = regex.compile(r"[\x21-\x7EÀ-ɏ]+")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.final = np.array([vocab[s + "</w>"] for s in symbols])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.again = np.zeros(0, dtype=bool)

    def forget(self) -> None:
        """Keep the words that were met again since the last time; most others never come back."""
        kept = np.flatnonzero(self.again)
        sizes = self.sizes[kept]
        if 2 * len(kept) > CACHE or 2 * sizes.sum() > CACHED_IDS:
            return self.clear()
        words = list(self.index)
        self.index = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.flat = self.flat[np.repeat(self.starts[kept], sizes) + ragged(sizes)]
        self.starts, self.sizes, self.again = np.cumsum(sizes) - sizes, sizes, np.zeros(len(kept), dtype=bool)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER if it does not merge) and what it makes."""
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of plain words, all of those of one length at a time."""
        out: list[np.ndarray] = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join(words[i] for i in rows.tolist()), dtype=np.uint8).reshape(-1, size)
            ids = self.inner[raw]
            ids[:, -1] = self.final[raw[:, -1]]
            rank, made = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                width = ids.shape[1]
                if width == 1:
                    stop = np.ones(len(rows), dtype=bool)
                else:
                    best = rank.argmin(axis=1)
                    at = np.arange(len(rows))
                    stop = rank[at, best] == NEVER
                for i in np.flatnonzero(stop).tolist():
                    out[rows[i]] = ids[i]
                if width == 1:
                    break
                go = ~stop
                rows, ids, rank, made, best = rows[go], ids[go], rank[go], made[go], best[go]
                at = np.arange(len(rows))
                ids[at, best] = made[at, best]
                keep = np.ones(ids.shape, dtype=bool)
                keep[at, best + 1] = False
                ids = ids[keep].reshape(len(rows), width - 1)
                keep = np.ones(rank.shape, dtype=bool)
                keep[at, best] = False
                rank, made = rank[keep].reshape(len(rows), width - 2), made[keep].reshape(len(rows), width - 2)
                for shift in (-1, 0):  # the pairs left and right of the new symbol
                    has = np.flatnonzero((best + shift >= 0) & (best + shift < width - 2))
                    col = best[has] + shift
                    rank[has, col], made[has, col] = self.ranks(ids[has, col], ids[has, col + 1])
        return out

    def ids_of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and their number; a part with a leading NUL is a whole word for the library."""
        by_library = [p[0] == "\0" or len(p) > LONGEST for p in parts]
        plain = [i for i, other in enumerate(by_library) if not other]
        rest = [i for i, other in enumerate(by_library) if other]
        found: list[np.ndarray] = [None] * len(parts)
        for i, ids in zip(plain, self.merge([parts[i].encode() for i in plain]) if plain else []):
            found[i] = ids
        given = [parts[i][1:] if parts[i][0] == "\0" else parts[i] for i in rest]
        for i, e in zip(rest, self.library.encode_batch(given, add_special_tokens=False)):
            found[i] = np.array(e.ids, dtype=np.int64)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.concatenate([np.zeros(0, dtype=np.int64), *found]).astype(np.uint32), sizes

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and their number."""
        different, part, number = self.parts(words)
        ids, sizes = self.ids_of_parts(different)
        starts, sizes = (np.cumsum(sizes) - sizes)[part], sizes[part]
        ends, upto = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(number)])
        return ids[np.repeat(starts, sizes) + ragged(sizes)], ends[upto[1:]] - ends[upto[:-1]]

    def learn(self, words: list[str]) -> np.ndarray:
        """Put the ids of new words into the cache; their numbers there."""
        ids, sizes = self.ids_of_words(words)
        numbers = len(self.index) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        self.again = np.concatenate([self.again, np.zeros(len(words), dtype=bool)])
        self.index.update(zip(words, numbers.tolist()))
        return numbers

    def is_plain(self, word: str) -> bool:
        shown = word.isprintable() if word.isascii() else self.plain.fullmatch(word) is not None
        return shown and not ("<|" in word and self.special.search(word))

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(different parts, the number of each part of each word, parts per word); all words are cut by one search.

        Words that are not plain are one part with a leading NUL, for the library.
        """
        plain = [self.is_plain(w) for w in words]
        # The newline ends a word and is part of none.
        found = self.cutter.findall("".join(w + "\n" for w, p in zip(words, plain) if p).lower())
        coded = pa.array(found, pa.string()).dictionary_encode()
        different, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        plain = np.array(plain, dtype=bool)
        if different:
            ends = np.flatnonzero(code == different.index("\n"))
            number[plain] = np.diff(ends, prepend=-1) - 1
            code = np.delete(code, ends)
        other = [(i, "\0" + words[i]) for i in np.flatnonzero(~plain).tolist() if words[i]]
        own = np.array([i for i, _ in other], dtype=np.int64)
        at = (np.cumsum(number) - number)[own]  # before the number of these words is set
        code = np.insert(code, at, len(different) + np.arange(len(other)))
        number[own] = 1
        return different + [p for _, p in other], code, number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number per text (null: none)."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words_of = np.diff(split.offsets.to_numpy())
        if len(self.index) > CACHE or len(self.flat) > CACHED_IDS:
            self.forget()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = known < 0
        self.again[known[~new]] = True
        if new.any():
            known[new] = self.learn([words[i] for i in np.flatnonzero(new).tolist()])
        codes = coded.indices.to_numpy()
        lengths = self.sizes[known][codes]
        out = self.flat[np.repeat(self.starts[known][codes], lengths) + ragged(lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(words_of)])
        return out, total[bounds[1:]] - total[bounds[:-1]]


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``."""
    return worker_state(f"word_tokenizer:{path}", lambda: WordTokenizer(path))
