"""Shared plumbing of the corpus operators: lineage cuts, column clashes, text batches, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import ready
from loam.lineage import cut

U64 = np.uint64
#: Bytes of text handled at once inside a Python worker; bounds its memory, not the length of a text.
SLICE_BYTES = 1 << 18


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts reach Python workers in batches of about 8 MB, so that their memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to write (compared without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def with_struct(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """Append the fields ``names`` of the struct column ``made``; extra columns of those names give way."""
    hidden = "__loam_made__"
    kept = [F.col(f"`{c}`") for c in without(df, names).columns]
    return df.withColumn(hidden, made).select(*kept, *[F.col(f"{hidden}.{n}").alias(n) for n in names])


def hash_below(key: str, share: float) -> Column:
    """Whether the row's key falls into ``share`` of the range of a 64-bit hash, however small the share is."""
    if share >= 1:
        return F.col(key).isNotNull()
    return F.xxhash64(key) < F.lit(int(share * 2**64) - 2**63)


def hash_sample(df: DataFrame, key: str, rows: int, of: int | None = None) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df`` (all if it has no more), chosen by a hash of ``key``; their number doesn't grow with ``df``."""
    return df.where(hash_below(key, rows / max(1, df.count() if of is None else of)))


def forest_of(n: int, p: np.ndarray, q: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes 0..n-1 that pairs (p, q) join to a lesser one; ``label`` holds and takes roots between calls."""
    label = np.arange(n) if label is None else label
    while len(p):
        x, y = label[p], label[q]
        apart = x != y
        if not apart.any():
            break
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(onward := label[label], label):
            label[:] = onward
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut a string array into runs of about ``size`` bytes, at least one text each."""
    n = len(texts)
    if n == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    piece = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
        if b > a:
            yield texts.slice(a, b - a)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the n + 1 offsets; null counts as empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit words (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class IntMap:
    """Immutable map from non-negative int64 to int32 with vectorised lookup (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            placed = self.keys[slot] == keys[todo]
            self.values[slot[placed]] = values[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out


_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(256, dtype=U64) + U64(77))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        # Kept for texts of common sizes; a very long text has its own.
        size = max(n, SLICE_BYTES * 2)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= SLICE_BYTES * 2:
            _powers[base] = have
    return have


def spans(buf: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked ``solid``; no run goes on from one text to the next."""
    n = len(buf)
    solid = np.append(solid, False)
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    prev = np.empty(n + 1, dtype=bool)
    prev[0] = False
    prev[1:] = solid[:n]
    return np.flatnonzero(solid & (~prev | begins)), np.flatnonzero(prev & (~solid | begins))


class SpanHash:
    """64-bit hashes of any spans of a byte array, from its prefix sums."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.empty(len(buf) + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(_BYTE[buf] * _power(_BASE, len(buf))[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _power(_BASE_INV, len(self.sums))[starts]
        return mix64(raw ^ (ends - starts).astype(U64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of bytes above 0x20) and, per text, n + 1 word offsets."""
    buf, offsets = flat_bytes(pc.utf8_lower(texts))
    if len(buf) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    starts, ends = spans(buf, offsets, buf > 32)
    return SpanHash(buf).of(starts, ends), np.searchsorted(starts, offsets)


_GRAM = [U64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams and, per text, the offsets.

    A text of 1 to n - 1 words has one gram, of all its words; one without words has none.
    """
    h, at = words(texts)
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(grams)])
    if len(h) == 0:
        return h, out_at
    padded = np.concatenate([h, np.zeros(n, U64)])
    acc = np.zeros(len(h), U64)
    for j in range(n):
        acc = mix64(acc ^ (padded[j : j + len(h)] * _GRAM[j % 5] + U64(j)))
    doc = np.repeat(np.arange(len(count)), count)
    left = at[doc + 1] - np.arange(len(h))
    full = left >= n
    out = np.empty(int(out_at[-1]), U64)
    rank = np.arange(len(h)) - at[doc]
    out[out_at[doc[full]] + rank[full]] = acc[full]
    for d in np.flatnonzero((count > 0) & (count < n)):
        x = np.zeros(1, U64)
        for j, w in enumerate(h[at[d] : at[d + 1]]):
            x = mix64(x ^ (np.array([w]) * _GRAM[j % 5] + U64(j)))
        out[out_at[d]] = mix64(x + U64(count[d]))[0]
    return out, out_at


def distinct_ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``ngrams``, each text's hashes sorted and without repeats."""
    h, at = ngrams(texts, n)
    if len(h) == 0:
        return h, at
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(at)))


def runs(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``key`` into tables of ``least`` rows, about, so that no key is split between two."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["key"].to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and held and held[-1]["key"][-1].as_py() == key[0] or rows + last < least:
            held.append(batch)
            rows += batch.num_rows
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held, rows = [batch.slice(last)], batch.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of a graph: (node, root), root being the least node of the component.

    Each round takes the least root among the neighbours and then that root's own root, until none changes.
    """
    ends = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = cut(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    roots = cut(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        near = edges.join(roots.select(F.col("node").alias("other"), F.col("root").alias("reached")), "other").groupBy("node").agg(F.min("reached").alias("reached"))
        step = cut(roots.join(near, "node").select("node", F.least("root", "reached").alias("root"), F.col("root").alias("old")))
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "old"))
        if step.where("root <> old").isEmpty():
            return step.select("node", "root")
        roots = step.drop("old")


def within(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids in ``gone``, and with one row (of the least text) of each id; rows with a null id stay."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__loam_rows__")).where("__loam_rows__ > 1")
    marks = gone.select("doc_id", F.lit(True).alias("__loam_gone__")).unionByName(again.select("doc_id", F.lit(False).alias("__loam_gone__")))
    marks = cut(marks.groupBy("doc_id").agg(F.max("__loam_gone__").alias("__loam_gone__")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(marks, "doc_id", "left").where("__loam_gone__ is null").select(*names)
    if marks.where("not __loam_gone__").isEmpty():
        return kept
    once = docs.join(marks.where("not __loam_gone__"), "doc_id").select(*names)
    row = F.struct(*names)
    least = once.groupBy(F.col("doc_id").alias("__loam_id__")).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("__loam_row__"))
    return kept.unionByName(least.select("__loam_row__.*"))
