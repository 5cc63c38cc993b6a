"""Byte-pair encoding by speculation and verification, and decoding.

Each distinct word of a batch is first cut by greedy longest match.  A cut is the true encoding exactly
when every two adjacent tokens are compatible, i.e. when the pair alone would be encoded as itself; numpy
tests all adjacent pairs of the batch at once by walking both tokens' merge trees back in time.  Only
words with an incompatible pair go through the exact merge loop.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import IntMap, flat_bytes, slices, table, with_struct

#: Splits a text into words before any merge; words never share a token.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose encoding a Python worker remembers at a time; bounds memory, changes no result.
REMEMBERED = 500_000
#: Bytes of text whose new words are encoded together.
SLICE_BYTES = 1 << 20
#: Longer words are proposed and merged one by one.
LONG_WORD = 256
ENCODED = ["n_tokens", "token_ids", "round_trip"]
NEVER = np.int64(1 << 40)


class Vocabulary:
    """Ranked byte tokens with the merge tree of each."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        n = len(tokens)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.longest: dict[bytes, int] = {}
        keys, values = [], []
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.longest[t] = max(1, self.longest.get(t, 1))
                continue
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
            parts = self.merge(t, below=i)
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
                self.longest[t[:1]] = max(len(t), self.longest.get(t[:1], 1))
        #: Tokens that no sequence of merges makes are never proposed.
        self.offered = {t: i for i, t in enumerate(tokens) if len(t) == 1 or self.left[i] >= 0}
        self.pairs = IntMap(np.array(keys, np.int64), np.array(values, np.int64))
        #: All tokens end to end, and where each begins and ends.
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n))
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)])
        steps: dict[int, int] = {}
        token_of = [-1]
        for t, i in self.offered.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                if key not in steps:
                    steps[key] = len(token_of)
                    token_of.append(-1)
                node = steps[key]
            token_of[node] = i
        #: Trie of the offered tokens: (node, byte) to node, and each node's token.
        self.steps, self.token_of = IntMap(np.array(list(steps), np.int64), np.array(list(steps.values()))), np.array(token_of)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a rank file: one base64 token and its rank a line."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path}: ranks must be 0..n-1 and hold every single byte")
        return cls(tokens)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and how many each has."""
        size = (self.ends - self.begins)[ids]
        before = np.cumsum(size) - size
        return self.table[np.repeat(self.begins[ids] - before, size) + np.arange(int(size.sum()))], size

    def merge(self, word: bytes, below: int = 1 << 60) -> list[int]:
        """Exact encoding: again and again join the leftmost adjacent pair of least rank (under ``below``)."""
        n = len(word)
        if n == 0:
            return []
        rank, ends, nxt, prev = self.rank, list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None and r < below]
        heapq.heapify(heap)
        while heap:
            r, i, j, end = heapq.heappop(heap)
            if not alive[i] or nxt[i] != j or j >= n or not alive[j] or ends[j] != end or rank.get(word[i:end]) != r:
                continue
            alive[j], ends[i], nxt[i] = False, end, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (q := rank.get(word[i : ends[nxt[i]]])) is not None and q < below:
                    heapq.heappush(heap, (q, i, nxt[i], ends[nxt[i]]))
            if prev[i] >= 0 and (q := rank.get(word[prev[i] : end])) is not None and q < below:
                heapq.heappush(heap, (q, prev[i], i, end))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : ends[i]]])
            i = nxt[i]
        return out

    def greedy(self, word: bytes) -> list[int]:
        """Longest-match proposal."""
        offered, longest, out, i, n = self.offered, self.longest, [], 0, len(word)
        while i < n:
            end = min(n, i + longest[word[i : i + 1]])
            while (t := offered.get(word[i:end])) is None:
                end -= 1
            out.append(t)
            i = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does the encoding of its bytes keep tokens a and b as they are?

        Going back in time, x and y are the parts of a and b that touch, px and py the tokens that x and y
        were merged into.  The pair breaks if x and y could have been merged earlier than either; the
        leftmost of equal ranks goes first.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        px = np.full(len(a), NEVER)
        py = px.copy()
        while len(at):
            key = x << 32 | y
            made = self.pairs.get(key).astype(np.int64)
            made[made < 0] = NEVER
            bad = (made < px) & (made <= py)
            good[at[bad]] = False
            opens_x, opens_y = self.right[x] >= 0, self.left[y] >= 0
            back_x = opens_x & (~opens_y | (x > y))
            back_y = opens_y & ~back_x
            px, py = np.where(back_x, x, px), np.where(back_y, y, py)
            x, y = np.where(back_x, self.right[x], x), np.where(back_y, self.left[y], y)
            on = ~bad & (opens_x | opens_y)
            at, x, y, px, py = at[on], x[on], y[on], px[on], py[on]
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words end to end, and how many each has; all words advance together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        word = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
        at = ends[word] - sizes[word]
        node, best, best_end = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), at.copy()
        owners, tokens = [], []
        while len(word):
            step = self.steps.get(node << 8 | buf[at]).astype(np.int64)
            stuck = (step < 0) | (at >= ends[word])
            node = np.where(stuck, 0, step)
            at = np.where(stuck, best_end, at + 1)
            owners.append(word[stuck])
            tokens.append(best[stuck])
            token = self.token_of[node]
            hit = ~stuck & (token >= 0)
            best[hit], best_end[hit] = token[hit], at[hit]
            on = ~(stuck & (at >= ends[word]))
            if not on.all():
                word, at, node, best, best_end = word[on], at[on], node[on], best[on], best_end[on]
        for k in np.flatnonzero(sizes > LONG_WORD):
            ids = self.greedy(words[k])
            owners.append(np.full(len(ids), k))
            tokens.append(np.array(ids))
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([np.zeros(0, np.int64), *tokens])[order], np.bincount(owner, minlength=len(words))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Exact encodings, as int32 bytes; short words are merged side by side, one join a round."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (8, 16, 32, 64):
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for some in np.array_split(group, max(1, len(group) // 20_000)):
                if len(some):
                    ids, count = self._merge_block([words[k] for k in some], width)
                    for k, row, n in zip(some.tolist(), ids, count.tolist()):
                        out[k] = row[:n].tobytes()
        for k in np.flatnonzero(sizes > low):
            out[k] = np.array(self.merge(words[k]), np.int32).tobytes()
        return out

    def _merge_block(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < count[:, None], self.byte_ids[raw], -1)
        final, done = np.zeros((len(words), width), np.int32), count.copy()
        row = np.arange(len(words))
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width + 1)
        while len(row):
            k = rank.argmin(axis=1)
            r = rank[np.arange(len(row)), k]
            on = r < NEVER
            if not on.all():
                final[row[~on]], done[row[~on]] = ids[~on, :width], count[~on]
                row, ids, rank, count, k, r = row[on], ids[on], rank[on], count[on], k[on], r[on]
                if not len(row):
                    break
            here = np.arange(len(row))
            moved = np.minimum(columns + (columns > k[:, None]), width)
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[:, width] = -1
            rank = np.take_along_axis(rank, np.minimum(moved[:, :width], width - 1), axis=1)
            rank[:, width - 1] = NEVER
            ids[here, k] = r
            count = count - 1
            before = np.maximum(k - 1, 0)
            rank[here, before] = np.where(k > 0, self._ranks(ids[here, before], ids[here, k]), rank[here, before])
            rank[here, k] = self._ranks(ids[here, k], ids[here, k + 1])
        return final, done

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = a.shape
        a, b = a.ravel(), b.ravel()
        made = self.pairs.get(np.where((a >= 0) & (b >= 0), a << 32 | b, (1 << 62) - 1)).astype(np.int64)
        made[made < 0] = NEVER
        return made.reshape(shape)

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Encodings of the words as int32 bytes, and how many needed the exact merge."""
        flat, sizes = self.propose(words)
        whole = flat.astype(np.int32).tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        out = [whole[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:])]
        if len(flat) < 2:
            return out, 0
        owner = np.repeat(np.arange(len(out)), sizes)
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(owner[1:][inner][~fine[back]]).tolist()
        for k, ids in zip(failing, self.merge_all([words[k] for k in failing])):
            out[k] = ids
        return out, len(failing)


class Encoder:
    """Encodes texts with a vocabulary, remembering the pieces it has met.

    A single space between two characters, the second of them no white space, always begins a word, so
    texts are cut there first; a text with any other use of spaces is cut by the word pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, regex.compile(WORD_PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.odd = re.compile(r"\A | (?=\s|\Z)").search
        self.failed = 0

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodings of pieces, each cut into its words."""
        cut = [self.split(p) for p in pieces]
        words = list({w for ws in cut for w in ws})
        encoded, failed = self.vocabulary.encode_words([w.encode() for w in words])
        self.failed += failed
        get = dict(zip(words, encoded)).__getitem__
        return {p: get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for p, ws in zip(pieces, cut)}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        found = []
        for t in texts:
            if not t:
                found.append(None if t is None else [])
            elif self.odd(t):
                found.append(self.split(t))
            else:
                found.append(self.split(t) if "\0" in t else t.replace(" ", "\0 ").split("\0"))
        known = self.known
        new = {p for ps in found if ps for p in ps if p not in known}
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {p for ps in found if ps for p in ps}
            known.update(self.learn(new))
        get = known.__getitem__
        return [None if ps is None else np.frombuffer(b"".join(map(get, ps)), np.int32) for ps in found]


def same_bytes(vocabulary: Vocabulary, flat: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
    """For each text, whether its ids (``flat`` from one of ``at`` to the next) decode to its very bytes."""
    made, size = vocabulary.decode(flat)
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    want, offsets = flat_bytes(texts)
    same = np.diff(ends) == np.diff(offsets)
    if np.array_equal(ends, offsets):
        wrong = np.flatnonzero(made != want)
        same[np.searchsorted(offsets, wrong, side="right") - 1] = False
        return same
    for k in np.flatnonzero(same):
        same[k] = np.array_equal(made[ends[k] : ends[k + 1]], want[offsets[k] : offsets[k + 1]])
    return same


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, broadcast) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(broadcast.value)
    return _encoders[name]


def encode(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Struct column (n_tokens, token_ids, round_trip) of a text column; round_trip: decoding gives the text back."""
    shared = _shared(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary, shared)
        for texts in batches:
            parts = []
            for piece in slices(texts, SLICE_BYTES):
                given = piece.to_pylist()
                ids = encoder.encode(given)
                sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
                gaps = np.array([x is None for x in ids])
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(gaps))
                back = pa.array(same_bytes(encoder.vocabulary, flat, at, piece), pa.bool_(), mask=gaps)
                parts.append(pa.StructArray.from_arrays([pa.array(sizes, pa.int64(), mask=gaps), lists, back], names=ENCODED))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_tokens long, token_ids array<int>, round_trip boolean")(text)


def decode(ids: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Text of a column of token ids; null for null, bytes that are no UTF-8 become U+FFFD."""
    shared = _shared(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _encoder(vocabulary, shared).vocabulary
        for lists in batches:
            made, size = words.decode(lists.flatten().to_numpy(zero_copy_only=False))
            count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])].tolist()
            raw = made.tobytes()
            yield pa.array([None if gap else raw[a:b].decode("utf-8", "replace") for gap, a, b in zip(lists.is_null().to_pylist(), at[:-1], at[1:])], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


@cache
def _loaded(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def _shared(path: str):
    """The vocabulary, read on the driver and sent to each executor once; its size doesn't depend on the data."""
    return SparkSession.getActiveSession().sparkContext.broadcast(_loaded(path))


def bpe_encode(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Append n_tokens, token_ids and round_trip (decoding the ids gives the text back) to every row.

    A null text has null in all three; an empty text has 0, an empty list and true.  Whole texts are encoded whatever
    their length; repeated rows stay.  Extra columns are kept, except any that has the name of an output
    column, which the output replaces.  An empty table gives an empty table.
    """
    return with_struct(docs, encode(F.col(text), vocabulary), ENCODED)


def bpe_decode(rows: DataFrame, ids: str = "token_ids", out: str = "decoded", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Append the text of ``ids`` as ``out``; the same rules for nulls, repeats and clashing columns as ``bpe_encode``."""
    return with_struct(rows, F.struct(decode(F.col(ids), vocabulary).alias(out)), [out])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, decoded again and compared with its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs).drop("text")
