"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; its high bits name a bin and its low bits compete for that bin's
minimum.  Empty bins borrow by optimal densification: bin i tries the bins h(i, 1), h(i, 2), ... of a
fixed random sequence until one that is not empty turns up.  Only the low ``bits`` of each minimum are
kept, packed end to end; ``estimate_jaccard`` corrects for their chance agreement.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import U64, mix64, ngrams, slices, table, with_struct

BINS, BITS, SHINGLE = 128, 4, 3
FIELDS = ["n_shingles", "n_empty_bins", "fingerprint"]


@cache
def donors(bins: int, tries: int) -> np.ndarray:
    """Bin probed by bin i at attempt a, as a (tries, bins) table; the same for every document."""
    i = np.arange(bins, dtype=U64)
    return np.stack([(mix64(mix64(i + U64(1)) ^ U64(0xA5A5 + 7919 * a)) % U64(bins)).astype(np.int64) for a in range(tries)])


def densify(minima: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row; rows that are wholly empty stay as they are."""
    bins = minima.shape[1]
    out, todo = minima.copy(), empty & ~empty.all(axis=1, keepdims=True)
    rows, cols = np.nonzero(todo)
    attempt, probes = 0, donors(bins, 64)
    while len(rows):
        if attempt == len(probes):
            probes = donors(bins, 2 * attempt)
        source = probes[attempt][cols]
        good = ~empty[rows, source]
        out[rows[good], cols[good]] = minima[rows[good], source[good]]
        rows, cols = rows[~good], cols[~good]
        attempt += 1
    return out


def checked(bins: int, bits: int) -> None:
    if bins < 2 or not 1 <= bits <= 32:
        raise ValueError("a fingerprint needs two bins at least and 1 to 32 bits a bin")


def sketch(texts: pa.Array, bins: int, bits: int, shingle: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    h, at = ngrams(texts, shingle)
    n = len(texts)
    full = U64(0xFFFFFFFFFFFFFFFF)
    minima = np.full(n * bins, full, U64)
    shift = U64(64 - (bins - 1).bit_length())
    where = np.repeat(np.arange(n), np.diff(at)) * bins + (h >> shift).astype(np.int64) % bins
    low = mix64(h) >> U64(1)
    np.minimum.at(minima, where, low)
    minima = minima.reshape(n, bins)
    empty = minima == full
    kept = densify(minima, empty) & U64((1 << bits) - 1)
    planes = (kept[:, :, None] >> np.arange(bits, dtype=U64) & U64(1)).astype(np.uint8).reshape(n, bins * bits)
    packed = np.packbits(planes, axis=1, bitorder="little")
    return np.diff(at), empty.sum(axis=1), [None if e else p.tobytes() for e, p in zip(empty.all(axis=1), packed)]


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> Column:
    """Struct column (n_shingles, n_empty_bins, fingerprint) of a text column."""
    checked(bins, bits)
    kind = pa.struct([("n_shingles", pa.int64()), ("n_empty_bins", pa.int32()), ("fingerprint", pa.binary())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for piece in slices(texts):
                n, gaps, packed = sketch(piece, bins, bits, shingle)
                parts.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gaps, pa.int32()), pa.array(packed, pa.binary())], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_shingles long, n_empty_bins int, fingerprint binary")(text)


def document_fingerprints(docs: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Append n_shingles, n_empty_bins and fingerprint to every row.

    Shingles are counted with repeats.  Null, empty and blank texts have no shingles, all bins empty and a
    null fingerprint; a text shorter than the shingle has one.  Equal texts have equal fingerprints; rows
    are never merged, so repeated rows stay.  Extra columns are kept, except any that has the name of an
    output column, which the output replaces.  An empty table gives an empty table.
    """
    return with_struct(docs, fingerprint(F.col(text), bins, bits, shingle), FIELDS)


def estimate_jaccard(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Jaccard estimate of two fingerprints: (share of equal bins - 2^-bits) / (1 - 2^-bits), within 0 and 1; null if either is."""
    checked(bins, bits)

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        sound = pc.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False)
        out = np.zeros(len(sound))
        if sound.any():
            at = pa.array(np.flatnonzero(sound))
            out[sound] = estimates(*(np.frombuffer(b"".join(z.take(at).to_pylist()), np.uint8).reshape(int(sound.sum()), -1) for z in (x, y)), bins, bits)
        return pa.array(out, mask=~sound)

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def estimates(x: np.ndarray, y: np.ndarray, bins: int, bits: int) -> np.ndarray:
    """Estimates of rows of packed fingerprints: the bins whose XOR is all zero, less those expected by chance."""
    apart = np.unpackbits(x ^ y, axis=1, bitorder="little", count=bins * bits).reshape(-1, bins, bits)
    chance = 2.0**-bits
    return np.clip(((~apart.any(axis=2)).mean(axis=1) - chance) / (1 - chance), 0, 1)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return document_fingerprints(docs).drop("text")
