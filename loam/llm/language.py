"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of order 0 to 3 with counts from a bounded sample of labelled documents.
A byte not seen after a context escapes to the next shorter one (escape method C, with exclusion of the
bytes already ruled out) and at last to a uniform code.  The trees are sorted arrays of the contexts and
of the (context, byte) pairs that occur, so their size follows the samples and not the alphabet.  The
statistics are frozen, so the code length of a byte depends on its last three predecessors alone; that of
each (context, byte) that some language has is worked out once for all languages, in 1/256 bit, and a
text's code length is an exact integer sum.  The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import IntMap, flat_bytes, hash_below, slices, table, with_struct

#: Labelled documents of each language that the statistics come from, about, chosen by a hash of the id; those
#: of more characters are not fitted on, and of the languages only the most frequent are told apart.
TRAIN_DOCS, TRAIN_CHARS, LANGUAGES = 250, 100_000, 200
#: Longest code per byte, in bits, with which a text still counts as written in a known language.
MAX_BITS_PER_BYTE = 7.0
UNIT, ORDER = 256, 3
START = b"\n\n\n"
FIELDS = ["lang_pred", "bits_per_byte", "margin_bits"]


def stream(texts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last three bytes before each byte of the texts (end to end in ``texts``), as one number, and the byte; START goes before every text."""
    lengths = np.diff(offsets)
    full = np.full(len(texts) + ORDER * len(lengths), START[0], np.int64)
    at = np.arange(len(texts)) + ORDER * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    full[at] = texts
    return full[at - 3] << 16 | full[at - 2] << 8 | full[at - 1], full[at]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


class ContextTree:
    """One language's contexts of order 0 to ORDER: for each its count and number of distinct bytes, and the (context, byte) counts.

    ``rest`` and ``kinds`` are what is left of the next shorter context's count and bytes once those seen in
    the context itself are excluded.
    """

    def __init__(self, context: np.ndarray, byte: np.ndarray):
        self.pairs, self.count, self.contexts, self.total, self.distinct = [], [], [], [], []
        self.rest, self.kinds = [], []
        for k in range(ORDER + 1):
            pairs, count = np.unique((context & (1 << 8 * k) - 1) << 8 | byte, return_counts=True)
            contexts, first = np.unique(pairs >> 8, return_index=True)
            sums = lambda x: np.add.reduceat(x, first) if len(x) else x
            self.pairs.append(pairs)
            self.count.append(count)
            self.contexts.append(contexts)
            self.total.append(sums(count))
            self.distinct.append(np.diff(np.append(first, len(pairs))))
            if k:
                low = contexts & (1 << 8 * (k - 1)) - 1
                at, _ = find(self.contexts[k - 1], low)
                seen, _ = find(self.pairs[k - 1], (pairs >> 8 & (1 << 8 * (k - 1)) - 1) << 8 | pairs & 255)
                self.rest.append(self.total[k - 1][at] - sums(self.count[k - 1][seen]))
                self.kinds.append(self.distinct[k - 1][at] - self.distinct[k])

    def bits(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Code length of each byte after its context."""
        out, todo = np.zeros(len(byte)), np.arange(len(byte))
        escaped = np.zeros(len(byte), bool)
        total, kinds = np.zeros(len(byte)), np.zeros(len(byte))
        for k in range(ORDER, -1, -1):
            if not len(todo) or not len(self.contexts[k]):
                break
            c = context[todo] & (1 << 8 * k) - 1
            at, known = find(self.contexts[k], c)
            fresh = known & ~escaped[todo]
            total[todo[fresh]], kinds[todo[fresh]] = self.total[k][at[fresh]], self.distinct[k][at[fresh]]
            escaped[todo[fresh]] = True
            live = known & (total[todo] > 0)
            pair, hit = find(self.pairs[k], c << 8 | byte[todo])
            hit &= live
            done, on = todo[hit], todo[live & ~hit]
            out[done] += np.log2((total[done] + kinds[done]) / self.count[k][pair[hit]])
            out[on] += np.log2((total[on] + kinds[on]) / kinds[on])
            if k:
                total[todo[known]], kinds[todo[known]] = self.rest[k - 1][at[known]], self.kinds[k - 1][at[known]]
            todo = todo[~hit]
        if len(todo):
            out[todo] += np.log2(256 - len(self.pairs[0]))
        return out


@dataclass(frozen=True)
class ContextModel:
    """The trees of all languages, and the code lengths in each of every (context, byte) that one of them has."""

    languages: tuple[str, ...]
    trees: tuple[ContextTree, ...]
    place: IntMap
    cost: np.ndarray

    @classmethod
    def build(cls, samples: dict[str, list[bytes]]) -> ContextModel:
        languages = tuple(sorted(samples))
        trees = []
        for lang in languages:
            offsets = np.cumsum([0, *map(len, samples[lang])])
            trees.append(ContextTree(*stream(np.frombuffer(b"".join(samples[lang]), np.uint8), offsets)))
        keys = np.unique(np.concatenate([np.zeros(0, np.int64), *[t.pairs[ORDER] for t in trees]]))
        cost = np.zeros((len(keys), len(languages)), np.int16)
        for k, t in enumerate(trees):
            cost[:, k] = cls.rounded(t.bits(keys >> 8, keys & 255))
        return cls(languages, tuple(trees), IntMap(keys, np.arange(len(keys))), cost)

    @staticmethod
    def rounded(bits: np.ndarray) -> np.ndarray:
        return np.round(np.minimum(bits, 60) * UNIT).astype(np.int16)

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """(text, language) code lengths in 1/256 bit."""
        buf, offsets = flat_bytes(texts)
        lengths = np.diff(offsets)
        sums = np.zeros((len(lengths), len(self.languages)), np.int64)
        full = np.flatnonzero(lengths)
        if not len(full):
            return sums
        context, byte = stream(buf, offsets)
        key = context << 8 | byte
        at = self.place.get(key)
        costs = self.cost[at] if len(self.cost) else np.zeros((len(at), len(self.languages)), np.int16)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            keys, back = np.unique(key[lost], return_inverse=True)
            for k, t in enumerate(self.trees):
                costs[lost, k] = self.rounded(t.bits(keys >> 8, keys & 255))[back]
        sums[full] = np.add.reduceat(costs, offsets[:-1][full], axis=0, dtype=np.int64)
        return sums


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> ContextModel:
    """Statistics from about ``per_language`` documents of each of the LANGUAGES most frequent values of ``lang``, whole texts of up to TRAIN_CHARS characters.

    Null langs are left out.  A language's share of the hash range is set from its count, so that no text is
    sorted or shuffled.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen |= (F.col("lang") == lang) & hash_below("doc_id", per_language / n)
    samples: dict[str, list[tuple]] = {lang: [] for lang in counts}
    for r in labelled.where(chosen).select("lang", "doc_id", "text").collect():
        samples[r["lang"]].append((r["doc_id"], r["text"].encode()))
    return ContextModel.build({lang: [t for _, t in sorted(rows)] for lang, rows in samples.items()})


def predict(text: Column, model: ContextModel) -> Column:
    """Struct column (lang_pred, bits_per_byte, margin_bits) of a text column."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            yield answer(model, texts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, bits_per_byte double, margin_bits double")(text)


def answer(model: ContextModel, texts: pa.Array) -> pa.Array:
    names, bits, margins = [], [], []
    for piece in slices(texts):
        if not model.languages:
            names += ["und"] * len(piece)
            bits += [None] * len(piece)
            margins += [None] * len(piece)
            continue
        sums = model.code_lengths(piece)
        length = np.diff(flat_bytes(piece)[1])
        best = sums.argmin(axis=1)
        low = sums[np.arange(len(sums)), best]
        rest = np.partition(sums, 1, axis=1)[:, 1] if sums.shape[1] > 1 else low
        per_byte = low / UNIT / np.maximum(length, 1)
        known = (length > 0) & (per_byte <= MAX_BITS_PER_BYTE)
        names += [model.languages[b] if k else "und" for b, k in zip(best, known)]
        bits += [b if n else None for b, n in zip(per_byte.tolist(), length)]
        margins += [m if n else None for m, n in zip(((rest - low) / UNIT).tolist(), length)]
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(bits, pa.float64()), pa.array(margins, pa.float64())], names=FIELDS)


def identify_language(docs: DataFrame, model: ContextModel) -> DataFrame:
    """Append lang_pred, bits_per_byte (of the shortest code) and margin_bits (to the next language).

    Null and empty texts, and texts whose shortest code is over MAX_BITS_PER_BYTE, are ``und``; the first two
    have null in the other columns.  Equal code lengths go to the alphabetically first language.  Whole texts
    are scored; repeated rows stay.  Extra columns are kept, except any with the name of an output column,
    which the output replaces.  An empty table gives an empty table; without training rows all is ``und``.
    """
    return with_struct(docs, predict(F.col("text"), model), FIELDS)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a known language, with its own columns; null and empty texts go, repeats stay, an empty table gives an empty one."""
    return docs.where(predict(F.col("text"), train(docs))["lang_pred"] != "und")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_language(docs, train(docs)).drop("text")
