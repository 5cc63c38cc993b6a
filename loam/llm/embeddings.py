"""Near-duplicate embeddings by sorted projection passes.

Each pass draws random hyperplanes, writes every vector's signs as one long key (a concatenation of one-bit
hashes), sorts all vectors by key and compares each with the next WINDOW of the order.  Vectors of high
cosine share long key prefixes and so lie near each other in some pass.  Verified pairs of all passes are
united.  The number of passes follows from how long the prefixes are that about WINDOW vectors share, which
the first pass measures in the table's dense regions, so that a pair just at the threshold is met there with
probability MEET, whatever the size of the table and the likeness of its vectors.

Vectors that are equal are one node throughout.  Passes run one after the other once the table is large, and
a pass leaves no more than a spanning forest of its verified pairs, about a row for each vector that has a
near copy; its sorted vectors are dropped with it, so disk use doesn't grow with the number of passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import components, cut, forest_of, hash_sample, runs, table, without

THRESHOLD, WINDOW, MEET, SEED = 0.95, 64, 0.98, 11
KEY_BITS = 62
#: Share of the vectors whose surroundings are no denser than those that the passes are made for.
DENSE = 0.99
#: Vectors for each range of the order, about, and those of a sample that the ranges are cut by.
RANGE_ROWS, SAMPLE_ROWS = 20_000, 500_000
#: Copies of vectors that are sorted at once; a table of more takes its passes one by one.
COPIES_AT_ONCE = 2_000_000
FIELDS = ["group_id", "kept"]
#: What a sorted pass yields: linked nodes (a, b), the vectors at the borders of its ranges, and counts of prefix lengths.
OUT_DDL = "kind int, a long, b long, key long, tie long, pass int, dim int, border long, side int, place int, v binary"


def passes_needed(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, meet: float = MEET, prefix: float = 0.0) -> int:
    """Passes after which a pair at the threshold has been within a window with probability ``meet``.

    In one pass two such vectors share a prefix of b bits with probability (1 - angle / pi) ** b, and about
    ``window`` vectors share the prefix when b = log2(rows / window) if unrelated vectors agree in every
    second bit; where they agree in more, ``prefix`` is the greater length measured.
    """
    bits = max(prefix, math.log2(max(rows, 1) / window))
    met = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if met >= meet else math.ceil(math.log(1 - meet) / math.log(1 - met))


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def keys_of(x: np.ndarray, k: int) -> np.ndarray:
    """Keys of unit vectors in pass ``k``."""
    planes = np.random.default_rng([SEED, k]).standard_normal((x.shape[1], KEY_BITS)).astype(np.float32)
    return ((x @ planes > 0) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1))).astype(np.int64)


def tie_of(node: np.ndarray) -> np.ndarray:
    return (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, unit vectors) of the batch for every length of vector."""
    sizes = batch["embedding"].value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == dim))
        flat = part["embedding"].flatten().to_numpy(zero_copy_only=False)
        yield part["node"].to_numpy(), unit(np.asarray(flat, np.float64).reshape(-1, dim))


KEYED_DDL = "range long, pass int, dim int, key long, tie long, node long, v binary"


def keyed(vectors: DataFrame, passes: list[int], cuts: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """One row for each vector and pass: its range of the order, key, tie-break and float32 bytes.

    ``cuts`` holds, by pass and length, the (key, tie) at which ranges begin.  Vectors of equal keys are
    parted by their ties, so that a dense region is cut as any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for node, x in by_length(batch):
                n, dim, tie = len(node), x.shape[1], tie_of(node)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                for k in passes:
                    key = keys_of(x, k)
                    borders = cuts.get((k, dim), np.zeros((0, 2), np.int64))
                    order = np.lexsort((np.concatenate([np.zeros(len(borders)), np.ones(n)]), np.concatenate([borders[:, 1], tie]), np.concatenate([borders[:, 0], key])))
                    before = np.cumsum(order < len(borders))
                    place = np.empty(n, np.int64)
                    place[order[order >= len(borders)] - len(borders)] = before[order >= len(borders)]
                    both = (np.full(n, k), np.full(n, dim))
                    yield pa.record_batch([pa.array(place), *(pa.array(z, pa.int32()) for z in both), pa.array(key), pa.array(tie), pa.array(node), packed], names=["range", "pass", "dim", "key", "tie", "node", "v"])

    return vectors.mapInArrow(run, KEYED_DDL)


def range_cuts(vectors: DataFrame, rows: int, passes: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """Where ranges begin, from a sample of SAMPLE_ROWS vectors, about; it decides the sizes of tasks and no result."""
    if rows <= RANGE_ROWS:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for node, x in by_length(batch):
                    for k in passes:
                        yield pa.record_batch([pa.array(np.full(len(node), k)), pa.array(np.full(len(node), x.shape[1])), pa.array(keys_of(x, k)), pa.array(tie_of(node))], names=["pass", "dim", "key", "tie"])

    got = hash_sample(vectors, "node", SAMPLE_ROWS // len(passes), rows).mapInArrow(run, "pass long, dim long, key long, tie long").toArrow()
    share = min(1.0, SAMPLE_ROWS // len(passes) / rows)
    columns = [got[c].to_numpy() for c in ("pass", "dim", "key", "tie")]
    order = np.lexsort(columns[::-1])
    group = np.stack(columns, axis=1)[order].reshape(-1, 4)
    # Ten sampled vectors a range at least, so that none is shorter than a window.
    step = max(10, int(RANGE_ROWS * share))
    out = {}
    for pair in {tuple(p) for p in group[:, :2].tolist()}:
        mine = group[(group[:, 0] == pair[0]) & (group[:, 1] == pair[1]), 2:]
        out[pair] = mine[step::step]
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def window_pairs(x: np.ndarray, threshold: float, window: int, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (earlier, later) of verified pairs within a window; the later one is at ``fresh`` or after."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(window, len(x) - 1) + 1):
        low = max(0, fresh - step)
        hit = low + np.flatnonzero(np.einsum("ij,ij->i", x[low : len(x) - step], x[low + step :]) >= threshold - 1e-6)
        left.append(hit)
        right.append(hit + step)
    return np.concatenate(left), np.concatenate(right)


def rows_out(kind: int, n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    names = [c.split() for c in OUT_DDL.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = {"kind": np.full(n, kind), **columns}
    return pa.record_batch([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in names], names=[c for c, _ in names])


def linked_rows(node: np.ndarray, x: np.ndarray, threshold: float, window: int, fresh: int = 0) -> pa.RecordBatch:
    p, q = window_pairs(x, threshold, window, fresh)
    at, root = forest_of(len(node), p, q)
    return rows_out(0, len(at), a=node[at], b=node[root])


def walk(threshold: float, window: int, measure: bool):
    """Over rows sorted by range and key: links within the windows of a range, its first and last rows, and prefix lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail, head = None, None, 0
        key, before = np.zeros(0, np.int64), None
        lengths = np.zeros(KEY_BITS + 2, np.int64)

        def border(side: int, x: np.ndarray, columns: list[np.ndarray], at: int) -> pa.RecordBatch:
            k, tie, node = columns
            n = len(node)
            same = {"pass": np.full(n, last[0]), "dim": np.full(n, last[1]), "border": np.full(n, last[2] + 1 - side), "side": np.full(n, side)}
            return rows_out(1, n, a=node, key=k, tie=tie, place=np.arange(at, at + n), v=pa.array([r.tobytes() for r in x], pa.binary()), **same)

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch[c].to_numpy() for c in ("pass", "dim", "range")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)]):
                part, mine = batch.slice(lo, hi - lo), tuple(group[lo].tolist())
                x = matrix(part["v"], mine[1])
                columns = [part[c].to_numpy() for c in ("key", "tie", "node")]
                if mine != last:
                    if tail is not None:
                        yield border(0, *tail, 0)
                    last, tail, head, key, before = mine, None, 0, np.zeros(0, np.int64), None
                if head < window:
                    yield border(1, x[: window - head], [c[: window - head] for c in columns], head)
                    head += min(window - head, len(x))
                if measure:
                    near = np.einsum("ij,ij->i", x, np.concatenate([np.zeros_like(x[:1]) if before is None else before, x[:-1]]))
                    key = np.concatenate([key, columns[0][near < threshold]])
                    if len(key) > window:
                        apart = np.frexp((key[window:] ^ key[: len(key) - window]).astype(float))[1]
                        lengths += np.bincount(KEY_BITS - apart, minlength=KEY_BITS + 2)
                        key = key[-window:]
                    before = x[-1:]
                fresh = 0 if tail is None else len(tail[0])
                if fresh:
                    x, columns = np.concatenate([tail[0], x]), [np.concatenate(z) for z in zip(tail[1], columns)]
                yield linked_rows(columns[2], x, threshold, window, fresh)
                tail = (x[-window:], [c[-window:] for c in columns])
        if tail is not None:
            yield border(0, *tail, 0)
        if measure:
            there = np.flatnonzero(lengths)
            yield rows_out(2, len(there), a=there, b=lengths[there])

    return run


def across(threshold: float, window: int):
    """Links between the last rows of a range and the first of the next; the rows of both, in their order, share a ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2_000):
            key = t["key"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                part = t.slice(lo, hi - lo).combine_chunks()
                fresh = int((part["side"].to_numpy() == 0).sum())
                if 0 < fresh < len(part):
                    x = matrix(part["v"], part["dim"][0].as_py())
                    yield linked_rows(part["a"].to_numpy(), x, threshold, window, fresh).select(["a", "b"])

    return run


def links(vectors: DataFrame, rows: int, threshold: float, window: int) -> DataFrame:
    """Linked nodes (a, b) of the distinct vectors (node, embedding), whose components are those of all verified pairs."""

    def sorted_passes(passes: list[int], measure: bool) -> DataFrame:
        ordered = keyed(vectors, passes, range_cuts(vectors, rows, passes))
        at_once = max(1, math.ceil(rows * len(passes) / RANGE_ROWS))
        order = ["pass", "dim", "range"]
        return cut(ordered.repartition(at_once, *order).sortWithinPartitions(*order, "key", "tie", "node").mapInArrow(walk(threshold, window, measure), OUT_DDL))

    def of(made: DataFrame) -> DataFrame:
        # The rows at a border: the last of a range (side 0), then the first of the next (side 1).
        border = made.where("kind = 1").select(F.xxhash64("pass", "dim", "border").alias("key"), "side", "place", "dim", "a", "v")
        met = border.repartition("key").sortWithinPartitions("key", "side", "place").mapInArrow(across(threshold, window), "a long, b long")
        return made.where("kind = 0").select("a", "b").unionByName(met)

    first = sorted_passes([0], True)
    counts = sorted(tuple(r) for r in first.where("kind = 2").groupBy("a").agg(F.sum("b").alias("n")).collect())
    reached, total, prefix = 0, sum(n for _, n in counts), 0
    for length, n in counts:
        reached += n
        if reached >= DENSE * total:
            prefix = length
            break
    passes = passes_needed(rows, threshold, window, prefix=prefix)
    each = max(1, COPIES_AT_ONCE // rows)
    found = [cut(of(first).distinct())]
    for low in range(1, passes, each):
        found.append(cut(of(sorted_passes(list(range(low, min(passes, low + each))), False)).distinct()))
    return reduce(DataFrame.unionByName, found)


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Append group_id (the least id of the row's group of near copies) and kept (that row represents its group).

    Vectors are near copies if their cosine is ``threshold`` at least; only vectors of one length are
    compared.  In a group of near-equal vectors larger than the window each meets its neighbours of the
    order, which ties the group together.  Rows that share an id are in one group, whatever their vectors.
    Rows with a null id, a null, empty or zero vector, or one with a null or non-finite element, are groups
    of their own and kept; a null id has a null group.  Rows that share an id are all kept or all not.  Ids
    may be of any type that has an order.  Other columns stay, except those with an output's name, which it
    replaces.  An empty table gives an empty table.
    """
    sound = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, e -> e is null or isnan(e) or abs(e) = double('inf')) and exists(embedding, e -> e <> 0)"
    # A node is 64 bits of two hashes of a vector.
    named = vectors.where(sound).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(SEED), "embedding")})
    nodes = cut(named.groupBy("h", "g").agg(F.any_value("embedding").alias("embedding")).select(F.col("h").bitwiseXOR(F.shiftleft("g", 1)).alias("node"), F.transform("embedding", lambda e: e.cast("float")).alias("embedding")))
    ids = named.select("vec_id", F.col("h").bitwiseXOR(F.shiftleft("g", 1)).alias("node")).distinct()
    rows = nodes.count()
    plain = without(vectors, FIELDS)
    if rows:
        pairs = links(nodes, rows, threshold, window)
        # An id with several vectors ties their nodes.
        several = ids.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("n > 1")
        tied = ids.join(several.select("vec_id", "a"), "vec_id").select("a", F.col("node").alias("b"))
        roots = components(pairs.unionByName(tied), "a", "b")
        rooted = cut(ids.join(roots, "node", "left").select("vec_id", F.coalesce("root", "node").alias("root")))
        least = rooted.groupBy("root").agg(F.min("vec_id").alias("__loam_group__"))
        groups = rooted.join(least, "root").groupBy(F.col("vec_id").alias("__loam_node__")).agg(F.min("__loam_group__").alias("__loam_group__"))
        plain = plain.join(groups, F.col("vec_id") == F.col("__loam_node__"), "left")
    else:
        plain = plain.withColumn("__loam_group__", F.lit(None).cast(dict(vectors.dtypes)["vec_id"]))
    group = F.coalesce("__loam_group__", "vec_id")
    return plain.select(*[F.col(f"`{c}`") for c in without(vectors, FIELDS).columns], group.alias("group_id"), (F.col("__loam_group__").isNull() | (F.col("__loam_group__") == F.col("vec_id"))).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings")).drop("embedding")
