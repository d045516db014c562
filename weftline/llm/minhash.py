"""One-permutation MinHash fingerprints.

Every shingle of five words is hashed once. The top bits of the hash choose one of
`bins` bins, the rest is its value there, and a bin keeps its least value. Empty bins are
filled by optimal densification: bin i asks the bins d(i, 1), d(i, 2), ... of a fixed hash
until it meets a filled one, so two fingerprints agree on a borrowed bin just as often as
on an own one. Only the lowest `bits` bits of each bin are stored, packed.

Two different values agree on b bits with probability 2**-b; `jaccard` takes that out:
J = (agreeing share - c) / (1 - c) with c = 2**-b, stored beside each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.textarrays import U64, mix, pieces, shingle_hashes, word_hashes, words

NONE = U64(2**64 - 1)


@lru_cache(1 << 16)
def donors(bins: int, t: int) -> np.ndarray:
    """The bin that each bin asks at try t, the same for all documents."""
    i = np.arange(bins, dtype=np.uint64)
    return (mix(i * U64(0x9E3779B97F4A7C15) + U64((t + 1) * 0xC2B2AE3D27D4EB4F % 2**64)) % U64(bins)).astype(np.int64)


def signatures(hashes: np.ndarray, rows: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """((rows, bins) values after densification, filled bins before it); a row without shingles is all NONE."""
    n, k = len(rows) - 1, bins.bit_length() - 1
    least = np.full(n * bins, NONE, U64)
    slot = np.repeat(np.arange(n) * bins, np.diff(rows)) + (hashes >> U64(64 - k)).astype(np.int64)
    np.minimum.at(least, slot, hashes & U64((1 << (64 - k)) - 1))
    least = least.reshape(n, bins)
    own = least != NONE
    filled = own.sum(axis=1)
    out, todo, t = least.copy(), ~own & (filled > 0)[:, None], 0
    while todo.any():
        r, c = np.nonzero(todo)
        d = donors(bins, t)
        got = own[r, d[c]]
        out[r[got], c[got]] = least[r[got], d[c[got]]]
        todo[r[got], c[got]] = False
        t += 1
    return out, filled


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each value, most significant first, packed into bytes."""
    low = ((values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & U64(1)).astype(np.uint8)
    return np.packbits(low.reshape(len(values), -1), axis=1)


def unpacked(signature: bytes, bits: int) -> np.ndarray:
    b = np.unpackbits(np.frombuffer(signature, np.uint8)).reshape(-1, bits)
    return b @ (1 << np.arange(bits - 1, -1, -1))


def jaccard(a: bytes, b: bytes, bits: int) -> float:
    """Estimated Jaccard similarity of two documents' shingle sets, chance agreement taken out."""
    c = 2.0**-bits
    return float(max(0.0, ((unpacked(a, bits) == unpacked(b, bits)).mean() - c) / (1 - c)))


def similarity(a: Column, b: Column, bits: int = 8) -> Column:
    """Column of `jaccard` for two signature columns of equal width; null where either is null."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist())
        return pa.array([None if p is None or q is None else jaccard(p, q, bits) for p, q in pairs], pa.float64())

    return run(a, b)


def fingerprints(docs: DataFrame, bins: int = 128, bits: int = 8, words_per_shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, n_filled, signature, chance) of every row of docs.

    bins is a power of two. Words are the runs between ASCII white space, byte for byte; a
    text of fewer words than a shingle has one shingle of all of them. n_shingles counts
    occurrences. A text without words, or a null one, has n_shingles 0 and a null
    signature. A very long text is hashed whole. A null doc_id stays null; repeated rows have
    a result each; equal values in a bin are one; other columns are not read; an empty table
    gives no rows.
    """
    if bins < 1 or bins & (bins - 1) or not 1 <= bits <= 32:
        raise ValueError("bins must be a power of two and bits between 1 and 32")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            starts, ends, at = words(data, offsets)
            h, per = shingle_hashes(word_hashes(data, starts, ends), at, words_per_shingle)
            values, filled = signatures(h, per, bins)
            sig = packed(values, bits)
            width = sig.shape[1]
            n = len(filled)
            cells = pa.BinaryArray.from_buffers(pa.binary(), n, [pa.py_buffer(np.packbits(filled > 0, bitorder="little").tobytes()), pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(per)), pa.array(filled.astype(np.int32)), cells, pa.array(np.full(n, 2.0**-bits))], ["doc_id", "n_shingles", "n_filled", "signature", "chance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, n_shingles long, n_filled int, signature binary, chance double")
