"""N-gram Jaccard join by parity sketches, size bands and the pigeonhole principle.

A document is the set of its distinct word n-grams; documents of equal sets are compared as one, here a class.  Every gram flips
one bit of a wide parity sketch, so two sketches differ in at most as many bits as the sets have differing
elements, d.  Pairs of Jaccard similarity t have d <= (1 - t) / (1 + t) * (|A| + |B|).  Classes of like size
share a band, and a band's sketch is cut into blocks: with more blocks than d, two similar classes agree in
some whole block (pigeonhole), and the agreeing blocks are found by an equi-join on (band, block, block's
bits).  Sets of up to TINY grams would agree in empty blocks only; they and their possible partners are
keyed by their least grams instead, of which two similar sets always share one.  Sets of over about 130
grams are sketched at a fixed rate of their grams, about SAMPLE of them; the sampled differences then leave
a block untouched with probability of at least 0.9999 for a pair just at the threshold.

Classes that meet in a block and pass the Hamming bound are linked into routing groups by a spanning forest
of each block, which is linear in the block.  Each class then sends its whole gram set to its routing group
once, and there every pair is compared exactly.  A block of many classes is cut into tiles of TILE classes
and a routing group into tiles of as many or of GRAMS_HELD grams, and tiles meet two at a time in tasks of their own, so
that no group is ever held in one task.  What leaves a tile is linear in it: each class's number of links
and a spanning forest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import U64, components, cut, distinct_ngrams, forest_of, mix64, runs, slices, table, within

GRAM, THRESHOLD = 3, 0.6
BLOCKS, SAMPLE, WIDTH = 64, 240, 3.0
FOLD, SIGMAS = 512, 4.0
TINY = 16
#: Classes of a block or routing group, and grams of the latter, that one tile holds, about; two tiles meet in a task.
TILE, GRAMS_HELD = 4096, 1_000_000
#: Blocks up to this size are compared pair by pair without a loop over them.
SMALL = 8
_PLACE, _DRAW, _BLOCK, _BIT = U64(0x51ED270B35AE62AD), U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


class Bands:
    """Band 0, of tiny sets, and overlapping ranges of sizes; two sizes over TINY of ratio up to 1 / threshold lie together in one."""

    def __init__(self, threshold: float):
        step = WIDTH * threshold
        if not 0 < threshold <= 1 or step <= 1:
            raise ValueError(f"threshold must be over {1 / WIDTH} and at most 1")
        self.threshold, self.spread = threshold, (1 - threshold) / (1 + threshold)
        low = (TINY + 1) * np.cumprod(np.concatenate([[1.0], np.full(int(np.log(1e9) / np.log(step)), step)]))
        self.low = np.concatenate([[1], np.ceil(low - 1e-9).astype(np.int64)])
        self.high = np.concatenate([[int(TINY / threshold + 1e-9)], np.floor(low * WIDTH + 1e-9).astype(np.int64)])
        self.blocks = np.minimum(BLOCKS, np.floor(self.spread * 2 * self.high + 1e-9).astype(np.int64) + 1)
        self.rate = np.where(self.spread * 2 * self.high < BLOCKS, 1.0, np.minimum(1.0, SAMPLE / self.high))
        self.keep = np.array([(1 << 64) - 1 if r >= 1 else int(r * 2**64) for r in self.rate], U64)
        self.whole = self.rate >= 1

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band) of all memberships."""
        inside = (sizes[:, None] >= self.low[None, :]) & (sizes[:, None] <= self.high[None, :])
        return np.nonzero(inside)

    def most(self, s: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Bits of the fold in which a similar pair with ``s`` sketched grams differs at most.

        Where all grams are sketched that is the bound on d itself.  Where they are sampled, d varies, and the
        fold's bits that two differences hit again are counted off.
        """
        d = self.spread * s
        high = d + SIGMAS * np.sqrt(d) + 1
        p = (1 - np.exp(-2 * high / FOLD)) / 2
        return np.floor(np.where(self.whole[band], d, np.minimum(high, FOLD * p + SIGMAS * np.sqrt(FOLD * p * (1 - p)))) + 1e-9)


def set_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each gram set; 0 for the empty one."""
    out, full = np.zeros(len(at) - 1, U64), np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = mix64(np.add.reduceat(mix64(h), at[:-1][full]) ^ mix64(np.bitwise_xor.reduceat(mix64(h ^ _PLACE), at[:-1][full])))
    return out


SKETCH_DDL = "node long, n long, head boolean, band int, s int, fold binary, keys array<long>"


def sketch(ids: pa.Array, texts: pa.Array, gram: int, bands: Bands, seen: set[int]) -> pa.RecordBatch:
    """One row (head) for each document, and one for each band of every class not in ``seen``.

    Documents without an id or without grams have a null node.
    """
    h, at = distinct_ngrams(texts, gram)
    sizes = np.diff(at)
    node = set_hash(h, at).view(np.int64)
    sound = (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    fresh = np.zeros(len(sizes), bool)
    for k in np.flatnonzero(sound).tolist():
        if (x := int(node[k])) not in seen:
            seen.add(x)
            fresh[k] = True
    doc, band = bands.of(np.where(fresh, sizes, 0))
    count = sizes[doc]
    row = np.repeat(np.arange(len(doc)), count)
    rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    token = rank + np.repeat(at[:-1][doc], count)
    first = (band[row] == 0) & (rank < (count - np.ceil(bands.threshold * count - 1e-9).astype(np.int64) + 1)[row])
    tiny_row, tiny_key = row[first], mix64(h[token[first]] ^ _PLACE) << U64(6)
    held = mix64(h[token] ^ _DRAW) <= bands.keep[band][row]
    row, token = row[held], token[held]
    g = h[token]
    block = (mix64(g ^ _BLOCK) % bands.blocks[band][row].astype(U64)).astype(np.int64)
    spot = row * BLOCKS + block
    bits, hit = np.zeros(len(doc) * BLOCKS, U64), np.zeros(len(doc) * BLOCKS, bool)
    order = np.argsort(spot, kind="stable")
    if len(order):
        begins = np.flatnonzero(np.diff(spot[order], prepend=-1))
        at_spot = spot[order][begins]
        bits[at_spot] = np.bitwise_xor.reduceat(mix64(g[order] ^ _PLACE), begins)
        hit[at_spot] = band[at_spot // BLOCKS] > 0
    where = np.flatnonzero(hit)
    b = band[where // BLOCKS].astype(U64)
    keys = mix64(bits[where] ^ mix64(b * U64(BLOCKS) + (where % BLOCKS).astype(U64))) << U64(6) | b
    owner = np.concatenate([where // BLOCKS, tiny_row])
    keys = np.concatenate([keys, tiny_key])[np.argsort(owner, kind="stable")].view(np.int64)
    bit = (mix64(g ^ _BIT) % U64(FOLD)).astype(np.int64)
    parity = (np.bincount(row * FOLD + bit, minlength=len(doc) * FOLD) & 1).astype(np.uint8).reshape(len(doc), FOLD)
    fold = np.packbits(parity, axis=1).tobytes()
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(doc)))])
    heads, width = len(sizes), FOLD // 8
    folds = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((np.arange(len(doc) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(fold)])
    null = lambda kind: pa.nulls(heads, kind)
    return pa.record_batch(
        [
            pa.concat_arrays([ids, pa.nulls(len(doc), ids.type)]),
            pa.array(np.concatenate([node, node[doc]]), mask=np.concatenate([~sound, np.zeros(len(doc), bool)])),
            pa.array(np.concatenate([sizes, count])),
            pa.array(np.arange(heads + len(doc)) < heads),
            pa.concat_arrays([null(pa.int32()), pa.array(band, pa.int32())]),
            pa.concat_arrays([null(pa.int32()), pa.array(np.bincount(row, minlength=len(doc)), pa.int32())]),
            pa.concat_arrays([null(pa.binary()), folds]),
            pa.concat_arrays([null(pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys))]),
        ],
        names=["doc_id", "node", "n", "head", "band", "s", "fold", "keys"],
    )


def sketches(docs: DataFrame, gram: int, bands: Bands) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            done = 0
            for piece in slices(batch["text"]):
                yield sketch(batch["doc_id"].slice(done, len(piece)), piece, gram, bands, seen)
                done += len(piece)

    named = docs.select("doc_id", "text")
    return named.mapInArrow(run, f"doc_id {dict(named.dtypes)['doc_id']}, {SKETCH_DDL}")


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows whose key occurs with more than one id, and each row's tile among the key's; rows are sorted by key and id."""
    for t in runs(batches):
        key, ids = t["key"].to_numpy(), t["id"].to_numpy()
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
        key, ids = key[first], ids[first]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        tiles = np.repeat(-(-size // TILE), size)
        keep = np.repeat(size > 1, size)
        tile = (np.arange(len(key)) - np.repeat(starts, size)) % tiles
        yield pa.record_batch([pa.array(key[keep]), pa.array(ids[keep]), pa.array(tile[keep], pa.int32()), pa.array(tiles[keep], pa.int32())], names=["key", "id", "tile", "tiles"])


def forest(bands: Bands) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that span the nodes of every block (or two tiles of one) as all pairs under the Hamming bound would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for t in runs(batches):
            key = t["key"].to_numpy()
            ids, n, s = (t[c].to_numpy() for c in ("id", "n", "s"))
            fold = np.frombuffer(b"".join(t["fold"].to_pylist()), np.uint64).reshape(-1, FOLD // 64)
            band = key & 63
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            last = np.repeat(ends, ends - starts)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def test(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
                apart = np.bitwise_count(fold[a] ^ fold[b]).sum(axis=-1, dtype=np.int64)
                return (apart <= bands.most(s[a] + s[b], band[b])) & (np.minimum(n[a], n[b]) >= bands.threshold * np.maximum(n[a], n[b]) - 1e-9)

            at = np.flatnonzero(np.repeat(ends - starts <= SMALL, ends - starts))
            for step in range(1, SMALL):
                at = at[at + step < last[at]]
                good = at[test(at, at + step)]
                left.append(ids[good])
                right.append(ids[good + step])
            for a, b in zip(starts[ends - starts > SMALL].tolist(), ends[ends - starts > SMALL].tolist()):
                mark = (int(band[a]), hashlib.blake2b(ids[a:b].tobytes(), digest_size=16).digest())
                if mark in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(mark)
                todo, queue = np.arange(a, b), []
                while len(todo):
                    if not queue:
                        queue, todo = [int(todo[0])], todo[1:]
                    x = queue.pop()
                    good = test(x, todo)
                    hit = todo[good]
                    if len(hit):
                        left.append(np.full(len(hit), ids[x]))
                        right.append(ids[hit])
                        queue += hit.tolist()
                        todo = todo[~good]
            x, y = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["node_a", "node_b"])

    return run


def tiled(rows: DataFrame, key: str) -> DataFrame:
    """Send every row to its key's pairs of tiles; ``key`` becomes the pair's, and ``cross`` tells that two tiles meet there."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    a, b = F.least("tile", "other"), F.greatest("tile", "other")
    band = F.col(key).bitwiseAND(63)
    pair = F.when(F.col("tiles") == 1, F.col(key)).otherwise(F.shiftleft(F.xxhash64(key, a, b), 6).bitwiseOR(band))
    return each.withColumn("cross", a != b).withColumn(key, pair).drop("other")


def gram_sets(gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The gram set, as bytes, of every row whose text has the set that its node names; each node once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            done = 0
            for piece in slices(batch["text"]):
                part = batch.slice(done, len(piece))
                done += len(piece)
                h, at = distinct_ngrams(piece, gram)
                node = part["node"].to_numpy()
                mine = np.flatnonzero(set_hash(h, at).view(np.int64) == node)
                mine = [k for k in mine.tolist() if not (int(node[k]) in seen or seen.add(int(node[k])))]
                kept = part.take(pa.array(mine, pa.int64()))
                sets = pa.array([h[at[k] : at[k + 1]].tobytes() for k in mine], pa.binary())
                yield pa.record_batch([kept["key"], kept["node"], kept["tile"], kept["tiles"], sets], names=["key", "node", "tile", "tiles", "grams"])

    return run


def overlaps(h: np.ndarray, row: np.ndarray, m: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of common grams of m different sets, some rows at a time: (first row, rows x m); ``h`` are the grams of the sets ``row``."""
    _, gram, df = np.unique(h, return_inverse=True, return_counts=True)
    often = df > 1
    held = often[gram]
    gram, row = (np.cumsum(often) - 1)[gram[held]], row[held]
    df = df[often]
    width = max(1, len(df))
    step = max(1, (1 << 22) // max(m, width))
    # A product of dense rows costs about a thirtieth of a nanosecond an element, a posting about ten.
    dense = m * width <= 1 << 24 and m * m * width / 300 <= float((df.astype(float) ** 2).sum())
    order = np.argsort(gram, kind="stable")
    posts, begin = row[order], np.cumsum(df) - df
    at = np.searchsorted(row, np.arange(m + 1))
    if dense:
        full = np.zeros((m, width), np.float32)
        full[row, gram] = 1
    for a in range(0, m, step):
        b = min(m, a + step)
        if dense:
            yield a, np.rint(full[a:b] @ full.T).astype(np.int64)
            continue
        made, low = np.zeros((b - a) * m, np.int64), at[a]
        while low < at[b]:
            high = max(low + 1, low + int(np.searchsorted(np.cumsum(df[gram[low : at[b]]]), 1 << 22)))
            g, many = gram[low:high], df[gram[low:high]]
            spot = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[g], many)
            made += np.bincount(np.repeat(row[low:high] - a, many) * m + posts[spot], minlength=len(made))
            low = high
        yield a, made.reshape(b - a, m)


def verified(threshold: float, pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact comparison of all sets of a routing group (or of two tiles of one, across).

    With ``pairs`` the linked pairs and their similarity; else each node, its number of links here and another
    node that it is linked to directly or not (itself if to none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 500):
            key = t["key"].to_numpy()
            every, tile, cross = t["node"].to_numpy(), t["tile"].to_numpy(), t["cross"].to_numpy()
            grams = t["grams"].to_pylist()
            a_out, b_out, x_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                nodes, first = np.unique(every[lo:hi], return_index=True)
                if len(nodes) < 2:
                    continue
                sets = [np.frombuffer(grams[lo + k], U64) for k in first.tolist()]
                n, part, m = np.array([len(x) for x in sets]), tile[lo:hi][first], len(nodes)
                label, links = np.arange(m), np.zeros(m, np.int64)
                for a, both in overlaps(np.concatenate(sets), np.repeat(np.arange(m), n), m):
                    rows = np.arange(a, a + len(both))
                    like = both / (n[rows][:, None] + n[None, :] - both)
                    hit = like >= threshold - 1e-12
                    hit[rows - a, rows] = False
                    if cross[lo]:
                        hit &= part[rows][:, None] != part[None, :]
                    links[rows] = hit.sum(axis=1)
                    p, q = np.nonzero(hit)
                    if pairs:
                        up = p + a < q
                        a_out.append(nodes[p[up] + a])
                        b_out.append(nodes[q[up]])
                        x_out.append(like[p[up], q[up]])
                        continue
                    forest_of(m, p + a, q, label)
                if not pairs:
                    a_out.append(nodes)
                    b_out.append(nodes[label])
                    x_out.append(links.astype(float))
            a, b, x = np.concatenate(a_out), np.concatenate(b_out), np.concatenate(x_out)
            if pairs:
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(x)], names=["node_a", "node_b", "jaccard"])
            else:
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(x.astype(np.int64))], names=["node", "other", "links"])

    return run


def compared(docs: DataFrame, threshold: float, gram: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, node), classes (node, rep: the least id, n) and what ``verified`` has of them."""
    bands = Bands(threshold)
    made = cut(sketches(docs, gram, bands))
    heads = made.where("head").select("doc_id", "node", "n")
    classes = heads.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    drawn = made.where("band is not null")
    rows = drawn.select(F.explode("keys").alias("key"), F.col("node").alias("id"))
    met = rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(shared, "key long, id long, tile int, tiles int")
    shape = drawn.groupBy(F.col("node").alias("id"), F.col("band").cast("long").alias("band")).agg(F.max(F.struct("n", "s", "fold")).alias("x")).select("id", "band", "x.*")
    full = tiled(met.withColumn("band", F.col("key").bitwiseAND(63)).join(shape, ["id", "band"]), "key")
    near = full.select("key", "id", "n", "s", "fold").repartition("key").sortWithinPartitions("key", "id").mapInArrow(forest(bands), "node_a long, node_b long")
    routes = components(near, "node_a", "node_b").join(classes, "node")
    sizes = routes.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / GRAMS_HELD, F.count("*") / TILE)).cast("int").alias("tiles"))
    placed = cut(routes.join(sizes, "root").select(F.col("root").alias("key"), "node", F.col("rep").alias("doc_id"), F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), "tiles"))
    texts = docs.where("text is not null").select("doc_id", "text").join(placed, "doc_id").select("key", "node", "tile", "tiles", "text")
    sets = tiled(texts.mapInArrow(gram_sets(gram), "key long, node long, tile int, tiles int, grams binary"), "key")
    kind = "node_a long, node_b long, jaccard double" if pairs else "node long, other long, links long"
    return heads, classes, cut(sets.repartition("key").sortWithinPartitions("key", "node").mapInArrow(verified(threshold, pairs), kind))


def set_pairs(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """All pairs of gram sets of Jaccard similarity >= ``threshold``, by their least ids: (doc_a, doc_b, jaccard), doc_a <= doc_b.

    The documents of a gram set follow from ``jaccard_join``'s copy_of.  The rules for nulls, repeats and ties
    are its own; where one id has several texts, a pair may hold an id twice.
    """
    _, classes, found = compared(docs, threshold, gram, True)
    for x in "ab":
        found = found.join(classes.select(F.col("node").alias(f"node_{x}"), F.col("rep").alias(f"rep_{x}")), f"node_{x}")
    return found.select(F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"), "jaccard")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, copy_of, n_links.

    class_id is the least id of all documents that links and equal gram sets join, directly or not, copy_of
    the least id of the documents of the same gram set, and n_links the number of other gram sets of Jaccard
    similarity >= ``threshold``, each verified on whole sets.

    A row with a null id, a null text or a text without words is a class of its own, under its own id,
    without links.  A text of fewer words than ``gram`` has one gram.  Repeated rows stay; rows that share
    an id but not a text are in the classes of their texts.  Ids may be of any type that has an order.  Extra
    columns are ignored.  An empty table gives no rows.
    """
    heads, classes, found = compared(docs, threshold, gram, False)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other <> node"), "node", "other")
    least = groups.join(classes, "node").groupBy("root").agg(F.min("rep").alias("group"))
    named = classes.select("node", "rep").join(links, "node", "left").join(groups.join(least, "root").select("node", "group"), "node", "left")
    rows = heads.select("doc_id", "node").join(named, "node", "left")
    return rows.select("doc_id", F.coalesce("group", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``docs`` with one document, of the least id, of each group of near copies, in its own columns.

    Documents in no pair stay, those with null ids or texts included; of rows that share an id the one of the
    least text stays.  Extra columns stay.  An empty table gives an empty table.
    """
    joined = jaccard_join(docs.select("doc_id", "text"), threshold, gram)
    return within(docs, joined.where("doc_id <> class_id").select("doc_id").distinct())


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
