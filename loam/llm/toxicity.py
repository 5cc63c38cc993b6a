"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k | x) = 1 / (1 + exp(w.x - theta_k)) with one weight vector w for all thresholds
theta_0 < theta_1 < ...; x marks the words of a text and their prefixes of 4 and 5 bytes, as 64-bit hashes.
Labels of 0 and 1 become three grades: 0 not toxic, 2 toxic with at least the median number of occurrences of
toxic-sided words, 1 the rest; a held-out test compares expected severity with those numbers.
The model is fitted on a bounded sample of labelled rows, less near copies, by proximal gradient steps with
an L1 penalty on the features that tell toxic documents from others; whole texts are scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import U64, IntMap, SpanHash, flat_bytes, ngrams, slices, spans, table, with_struct

#: Labelled rows of each label that are fitted on, chosen by a hash of their id; texts of more characters are not fitted on.
TRAIN_ROWS, TRAIN_CHARS = 2500, 20_000
#: Documents of at least this expected severity are rejected.
REJECT_AT = 0.4
MIN_DOCS, MIN_Z, L1, STEPS = 4, 5.0, 1e-4, 500
#: Counters of how many texts hold a feature, which tell the rare ones; a shared one only keeps a rare feature longer.
COUNTERS = 1 << 22
FIELDS = ["severity", "grade", "toxic"]
#: Bytes of words: letters, digits and all of more than one byte.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_KINDS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, feature) of every word, then of its prefixes of 4 and 5 bytes if it has more, with repeats; and how many are words."""
    buf, offsets = flat_bytes(pc.utf8_lower(texts))
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    starts, ends = spans(buf, offsets, WORD_BYTE[buf])
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashed = SpanHash(buf)
    found = [(text, hashed.of(starts, ends) ^ _KINDS[0])]
    for size, kind in ((4, _KINDS[1]), (5, _KINDS[2])):
        long = ends - starts > size
        found.append((text[long], hashed.of(starts[long], starts[long] + size) ^ kind))
    return np.concatenate([t for t, _ in found]), (np.concatenate([f for _, f in found]) >> U64(1)).astype(np.int64), len(starts)


@dataclass(frozen=True)
class OrdinalModel:
    """Feature weights shared by all thresholds, and the ascending thresholds; grades are 0..len(thresholds)."""

    place: IntMap
    weights: np.ndarray
    thresholds: tuple[float, ...]

    @classmethod
    def of(cls, keys: np.ndarray, weights: np.ndarray, thresholds: tuple[float, ...]) -> OrdinalModel:
        return cls(IntMap(keys, np.arange(len(keys))), weights, thresholds)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Sum of the weights of each text's features, each once."""
        out = []
        for piece in slices(texts):
            text, feature, _ = features(piece)
            at = self.place.get(feature).astype(np.int64)
            hit = at >= 0
            width = max(1, len(self.weights))
            pairs = np.unique(text[hit] * width + at[hit])
            out.append(np.bincount(pairs // width, self.weights[pairs % width] if len(pairs) else None, minlength=len(piece)))
        return np.concatenate([np.zeros(0), *out])

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of P(grade > k)."""
        theta = np.array(self.thresholds)
        return (1 / (1 + np.exp(np.clip(theta[None, :] - np.asarray(scores)[:, None], -50, 50)))).sum(axis=1)

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Most probable grade."""
        theta = np.array(self.thresholds)
        below = 1 / (1 + np.exp(np.clip(np.asarray(scores)[:, None] - theta[None, :], -50, 50)))
        edges = np.concatenate([np.zeros((len(below), 1)), below, np.ones((len(below), 1))], axis=1)
        return np.diff(edges, axis=1).argmax(axis=1)


def occurrences(text: np.ndarray, word: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Each text's number of toxic-sided words, those in ten times the share of toxic texts than of others; (text, word) with repeats."""
    keys, word = np.unique(word, return_inverse=True)
    width = max(1, len(keys))
    once = np.unique(text * width + word)
    seen = np.bincount(once % width, minlength=len(keys))
    bad = np.bincount(once % width, toxic[once // width], minlength=len(keys))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    sided = (bad >= MIN_DOCS) & (bad / n1 > 10 * (seen - bad + 0.5) / n0)
    return np.bincount(text, sided[word], minlength=len(toxic)).astype(np.int64)


def graded(count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 of 0/1 labels."""
    median = np.median(count[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, np.where(count >= max(1, median), 2, 1), 0)


def fit(text: np.ndarray, feature: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> OrdinalModel:
    """Fit weights and thresholds to distinct (text, feature) pairs; with fewer than two grades present every text scores grade 0.

    Only features whose shares of toxic and of other texts differ by at least MIN_Z standard errors count.
    """
    if len(set(grades.tolist())) < 2:
        return OrdinalModel.of(np.zeros(0, np.int64), np.zeros(0), (50.0,))
    top, n = int(grades.max()), len(grades)
    keys, cols, seen = np.unique(feature, return_inverse=True, return_counts=True)
    bad = np.bincount(cols, grades[text] > 0, minlength=len(keys))
    n1 = max(1, int((grades > 0).sum()))
    n0 = max(1, n - n1)
    p = seen / (n0 + n1)
    good = (seen >= MIN_DOCS) & (np.abs(bad / n1 - (seen - bad) / n0) >= MIN_Z * np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)))
    held = good[cols]
    rows, cols, keys = text[held], (np.cumsum(good) - 1)[cols[held]], keys[good]
    weight = weight / weight.sum()
    share = np.clip([weight[grades <= k].sum() for k in range(top)], 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log(share / (1 - share)))
    w, m, v = np.zeros(len(keys)), np.zeros(len(keys) + top), np.zeros(len(keys) + top)
    here = np.arange(n)
    for step in range(1, STEPS + 1):
        score = np.bincount(rows, w[cols], minlength=n)
        cum = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50)))
        edges = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[here, grades + 1] - edges[here, grades], 1e-9)
        up, down = slope[here, grades + 1], slope[here, grades]
        grad_w = np.bincount(cols, (weight * (up - down) / p)[rows], minlength=len(w))
        grad_t = np.array([-(weight * (np.where(grades == k, up, 0) - np.where(grades == k + 1, down, 0)) / p).sum() for k in range(top)])
        g = np.concatenate([grad_w, grad_t])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.05 / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        move = rate * m / (1 - 0.9**step)
        w = w - move[: len(w)]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate[: len(w)] * L1)
        theta = np.maximum.accumulate(theta - move[len(w) :])
    kept = np.abs(w) > 1e-3
    return OrdinalModel.of(keys[kept], w[kept], tuple(float(t) for t in theta))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most ``rows`` labelled documents of each label, of up to TRAIN_CHARS characters.

    Null ids, labels and texts are left out; of a document with several labels the worst counts.  The sample
    is weighted back to the labels' true shares.  Only ids and labels are sorted; the texts of the chosen ids
    (at most 2 * ``rows``, hence the broadcast) come from one filtered scan, and one task fits the model.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (0, 1)]
    sample = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({tuple(r) for b in batches for r in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "toxic")))})
        made = fit_labelled([t for _, t, _ in got], np.array([g for _, _, g in got], int), totals)
        yield pa.record_batch([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    found = sample.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit_labelled([], np.zeros(0, int), totals)


def fit_labelled(texts: list[str], toxic: np.ndarray, totals: dict[int, int]) -> OrdinalModel:
    """Fit texts with 0/1 labels; of those with one least shingle hash, as copies have, only the first counts.  ``totals``: documents of each label."""
    first, found, words, begin = [], [], [], 0
    often = np.zeros(COUNTERS, np.int32)
    for piece in slices(pa.array(texts, pa.string()), 1 << 18):
        h, at = ngrams(piece, 3)
        first += [int(h[a:b].min()) if b > a else -1 for a, b in zip(at[:-1], at[1:])]
        text, feature, whole = features(piece)
        words.append(((text[:whole] + begin).astype(np.int32), feature[:whole].copy()))
        order = np.lexsort((feature, text))
        text, feature = text[order], feature[order]
        once = np.ones(len(text), bool)
        once[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
        found.append(((text[once] + begin).astype(np.int32), feature[once]))
        np.add.at(often, feature[once] % COUNTERS, 1)
        begin += len(piece)
    if not found:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0))
    seen: set[int] = set()
    kept = np.array([not (x in seen or seen.add(x)) for x in first], bool)
    number = np.cumsum(kept) - 1

    def of_kept(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of kept texts, less those of features too rare to count, which most are."""
        some = [(t[x], f[x]) for t, f in pairs for x in [kept[t] & (often[f % COUNTERS] >= MIN_DOCS)]]
        pairs.clear()
        return number[np.concatenate([t for t, _ in some])], np.concatenate([f for _, f in some])

    toxic = toxic[kept]
    grades = graded(occurrences(*of_kept(words), toxic), toxic)
    share = {t: totals.get(t, 0) / max(1, (toxic == t).sum()) for t in (0, 1)}
    return fit(*of_kept(found), grades, np.array([share[t] for t in toxic.tolist()], float))


def score(text: Column, model: OrdinalModel) -> Column:
    """Struct column (severity, grade, toxic) of a text column."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            sums = model.scores(texts)
            severity = np.round(model.severity(sums), 9)
            yield pa.StructArray.from_arrays([pa.array(severity), pa.array(model.grades(sums), pa.int32()), pa.array(severity >= REJECT_AT)], names=FIELDS)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "severity double, grade int, toxic boolean")(text)


def grade_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Append severity (expected grade), grade (most probable) and toxic (severity >= REJECT_AT).

    A null or empty text has no features and gets the model's baseline.  Whole texts are scored; repeated rows
    get equal grades and stay.  Extra columns are kept, except any with the name of an output column, which
    the output replaces.  An empty table gives an empty table; without labels of both kinds nothing is toxic.
    """
    return with_struct(docs, score(F.col("text"), model), FIELDS)


def keep_mild(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with its own columns; null and empty texts and repeats stay, an empty table gives an empty one."""
    return docs.where(~score(F.col("text"), train(docs, labels))["toxic"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
