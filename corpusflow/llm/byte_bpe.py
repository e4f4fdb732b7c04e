"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when every token
encodes to itself and every neighbouring pair encodes to itself (Berglund and
van der Merwe, 2023). That makes encoding a regular relation. The transducer
reads bytes; a state is the set of ways to read on: the tokens of the one
encoding of the bytes up to some earlier place, and the vocabulary-trie node of
the token begun there. Tokens that all ways share are emitted, so that output
lags by a bounded lookahead. States are made when they are first reached.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import ragged, slices, whole_text, worker_state

# Arcs of the transducer, and different matches, that a worker keeps. Beyond
# that it starts afresh; results do not depend on it.
ARCS = 800_000
MATCHES = 400_000
ENCODE_BYTES = 2 << 20
ROOT = 0
NODE = 24  # bits of a trie node
NODES = (1 << NODE) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Transducer:
    """Encodes one match (bytes) at a time by the ranks of a vocabulary.

    A way is one number, ``chain << NODE | trie node``. A chain is a list of
    tokens not yet emitted, as a number too: (chain before it, last token); the
    first token of all chains of a state is the token emitted last.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][byte]
            self.token_at[node] = rank
        self.split: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.chain_of: dict[int, int] = {}
        self.last, self.before, self.head = [-1], [-1], [-1]
        self.fits: dict[int, bool] = {}
        self.same: dict[int, int] = {}
        start = (0,)
        self.states = [start]
        self.number = {start: 0}
        self.arcs: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_number: dict[tuple[int, ...], int] = {(): 0}

    def merged(self, text: bytes) -> list[int]:
        """The merges themselves, for the few bytes of a pair of tokens."""
        ranks = self.ranks
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes and tokens that no merges reach."""
        if token not in self.split:
            text, ranks = self.bytes_of[token], self.ranks
            self.split[token] = None
            if len(text) > 1:
                del ranks[text]  # stop just before the last merge
                parts = self.merged(text)
                ranks[text] = token
                if len(parts) == 2 and max(parts) < token:
                    self.split[token] = (parts[0], parts[1])
        return self.split[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def fit(self, left: int, right: int) -> bool:
        """True when the encoding of both tokens' bytes is just these two.

        Merges are undone at the border, the latest first. Whenever the two
        tokens at the border could merge earlier than the merge undone last,
        that merge would have come first and the pair cannot stand.
        """
        ranks, text = self.ranks, self.bytes_of
        limit = 1 << 60
        while True:
            joint = ranks.get(text[left] + text[right])
            if joint is not None and joint < limit:
                return False
            parts_left, parts_right = self.halves(left), self.halves(right)
            if parts_left is not None and (parts_right is None or left > right):
                limit, left = left, parts_left[1]
            elif parts_right is not None:
                # Of equal ranks the left one merges first, so this one counts as later.
                limit, right = right + 1, parts_right[0]
            else:
                return True

    def chain(self, before: int, token: int) -> int:
        key = before << 20 | token
        found = self.chain_of.get(key)
        if found is None:
            found = self.chain_of[key] = len(self.last)
            self.last.append(token)
            self.before.append(before)
            # The chain up to the first token after the root.
            self.head.append(found if self.before[before] < 0 else self.head[before])
        return found

    def arc(self, state: int, byte: int) -> int:
        """Make the arc of ``state`` for ``byte``: output number << 32 | next state."""
        children, token_at, last, fits = self.children, self.token_at, self.last, self.fits
        ahead = []
        for way in self.states[state]:
            child = children[way & NODES].get(byte)
            if child is None:
                continue
            chain = way >> NODE
            token = token_at[child]
            if token >= 0:
                pair = last[chain] << 20 | token
                known = fits.get(pair)
                if known is None:
                    before = last[chain]
                    known = fits[pair] = self.reachable(token) and (before < 0 or self.fit(before, token))
                if known:
                    closed = self.chain(chain, token)
            if children[child]:
                ahead.append(chain << NODE | child)
        ahead.append(closed << NODE)
        emitted: tuple[int, ...] = ()
        head = self.head
        first = head[ahead[0] >> NODE]
        if first >= 0:  # no way is left that starts right after the token emitted last
            for way in ahead:
                if head[way >> NODE] != first:
                    break
            else:
                ahead, emitted = self.rebased(ahead)
        same = self.same
        target = tuple([same.setdefault(w, w) for w in ahead])
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
        output = self.output_number.get(emitted)
        if output is None:
            output = self.output_number[emitted] = len(self.outputs)
            self.outputs.append(emitted)
        found = self.arcs[state << 8 | byte] = output << 32 | number
        return found

    def listed(self, chain: int) -> list[int]:
        """Tokens of a chain in order, without the one at its root."""
        out = []
        while self.before[chain] >= 0:
            out.append(self.last[chain])
            chain = self.before[chain]
        return out[::-1]

    def rebased(self, ways: list[int]) -> tuple[list[int], tuple[int, ...]]:
        """Take the tokens that all ways share off their chains."""
        lists = [self.listed(w >> NODE) for w in ways]
        shared = 0
        for tokens in zip(*lists):
            if tokens.count(tokens[0]) < len(tokens):
                break
            shared += 1
        root = self.root(lists[0][shared - 1])
        out = []
        for way, tokens in zip(ways, lists):
            chain = root
            for token in tokens[shared:]:
                chain = self.chain(chain, token)
            out.append(chain << NODE | way & NODES)
        return out, tuple(lists[0][:shared])

    def root(self, token: int) -> int:
        """The chain that holds only the token emitted last."""
        key = -1 - token
        found = self.chain_of.get(key)
        if found is None:
            found = self.chain_of[key] = len(self.last)
            self.last.append(token)
            self.before.append(-1)
            self.head.append(-1)
        return found

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        if len(self.arcs) > ARCS:
            self.reset()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in match:
            found = arcs.get(state << 8 | byte)
            if found is None:
                found = self.arc(state, byte)
            state = found & 0xFFFFFFFF
            if found > state:
                out += self.outputs[found >> 32]
        return out + self.listed(self.states[state][-1] >> NODE)


# UTF-8 states: 0 between characters, 1-3 that many continuation bytes to come,
# 4-7 after E0, ED, F0, F4 (narrower second byte), 8 not UTF-8.
_SECOND = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return 8
    if state in (1, 2, 3):
        return state - 1 if 0x80 <= byte <= 0xBF else 8
    if state in _SECOND:
        low, high, after = _SECOND[state]
        return after if low <= byte <= high else 8
    return 8


class Decoder:
    """Token bytes, and the state machine lifted from bytes to tokens as tokens are met."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        size = max(bytes_of) + 1
        tokens = [bytes_of.get(i, b"") for i in range(size)]
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.after = np.full(size, -1, dtype=np.int8)  # from state 0
        self.moves: dict[tuple[int, int], int] = {}

    def move(self, state: int, token: int) -> int:
        key = (state, token)
        if key not in self.moves:
            for byte in self.tokens[token]:
                state = utf8_step(state, byte)
            self.moves[key] = state
        return self.moves[key]

    def stream(self) -> "Stream":
        return Stream(self)


class Stream:
    """Decodes ids that arrive in blocks; holds back the bytes of an unfinished character."""

    def __init__(self, decoder: Decoder) -> None:
        self.decoder, self.state, self.held = decoder, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters that are whole so far."""
        d = self.decoder
        for token in np.unique(ids[d.after[ids] < 0]).tolist():
            d.after[token] = d.move(0, token)
        hard = np.flatnonzero(d.after[ids])
        at, state = 0, self.state
        while at < len(ids):
            if state == 0:  # go on to the next token that ends inside a character
                k = bisect_left(hard, at)
                if k == len(hard):
                    break
                at = int(hard[k])
            state = d.move(state, int(ids[at]))
            at += 1
        self.state = state
        sizes = d.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.held + d.raw[np.repeat(d.starts[ids] - (ends - sizes), sizes) + np.arange(total, dtype=np.int32)].tobytes()
        if state == 0 or state == 8:
            self.held = b""
            return raw
        back = 1
        while raw[-back] & 0xC0 == 0x80:
            back += 1
        self.held = raw[-back:]
        return raw[:-back]

    def close(self) -> tuple[bytes, bool]:
        """What is left, and whether everything was UTF-8."""
        rest, self.held = self.held, b""
        return rest, self.state == 0


class Codec:
    """Encodes texts match by match, keeping the ids of different matches."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(read_ranks(path))
        self.decoder = Decoder(self.transducer.bytes_of)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []  # the ids of a match, as text
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def learn(self, matches: list[str]) -> None:
        """Encode new matches, in order, so that neighbours share the way through the transducer."""
        found = [self.transducer.encode(m.encode()) for m in matches]
        for match in matches:
            self.number[match] = len(self.number)
        self.shown += [" ".join(map(str, ids)) for ids in found]
        sizes = np.array([len(ids) for ids in found], dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, as numbers and as decimal numbers joined by one space."""
        found = [self.pattern.findall(text) for text in texts]
        if len(self.number) > MATCHES:
            self.clear()
        new = set(itertools.chain.from_iterable(found)).difference(self.number)
        if new:
            self.learn(sorted(new))
        per_text = np.array([len(f) for f in found], dtype=np.int64)
        codes = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(found)), dtype=np.int64, count=int(per_text.sum()))
        sizes = self.sizes[codes]
        ids = self.ids[np.repeat(self.starts[codes], sizes) + ragged(sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(per_text)])
        shown, own = self.shown.__getitem__, codes.tolist()
        cuts = ends.tolist()
        text_of = [" ".join(map(shown, own[a:b])) for a, b in zip(cuts, cuts[1:])]
        return np.split(ids, upto[ends[1:-1]]) if texts else [], text_of

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> tuple[bytes, bool]:
        stream, out = self.decoder.stream(), []
        for a in range(0, len(ids), block):
            out.append(stream.feed(ids[a : a + block]))
        rest, valid = stream.close()
        return b"".join([*out, rest]), valid


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a vocabulary file and pattern."""
    return worker_state(f"byte_bpe:{path}:{pattern}", lambda: Codec(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, valid_utf8.

    The ids are those of ``Codec.encode`` over the whole text, then decoded as
    a stream. Null and empty texts have no ids and the hash of nothing; rows of
    one id and null ids are rows like any other; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text).alias("body"))

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 1, ENCODE_BYTES):
            number, hashes, decoded, valid = [], [], [], []
            for flat, shown in zip(*own.encode(batch.column(1).to_pylist())):
                number.append(len(flat))
                hashes.append(hashlib.sha256(shown.encode()).hexdigest())
                raw, fine = own.decode(flat)
                decoded.append(hashlib.sha256(raw).hexdigest())
                valid.append(fine)
            columns = [batch.column(0), pa.array(number, pa.int64()), pa.array(hashes), pa.array(decoded), pa.array(valid)]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")
