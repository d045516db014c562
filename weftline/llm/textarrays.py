"""Numpy views of Arrow string columns, shared by the operators of this package.

A batch of documents is one UTF-8 byte buffer with row offsets; words, hashes,
shingles and window minima are computed for all rows of the buffer at once.
A null text counts as an empty one; each operator says what it does with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            steps = np.full(size, self.base, U64), np.full(size, self.inverse, U64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers(BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values, with a leading zero."""
    up, _ = POWERS.upto(len(values) + 1)
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) ranges that depend on their content and length alone."""
    _, down = POWERS.upto(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    return np.ndarray(len(data) + 1, U64, room, strides=(1,))


def blocks_of(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset of each range's first block, number of its range, block in it, place) of ranges cut into eights."""
    count = (lengths + 7) >> 3
    owner = np.repeat(np.arange(len(starts)), count)
    first = np.cumsum(count) - count
    nth = np.arange(len(owner)) - first[owner]
    return first, owner, nth, starts[owner] + 8 * nth


TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)
LONG = U64(1 << 63)


def content_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key for the bytes of each range [start, end). Up to seven bytes are their own key,
    with their number on top. A longer range has the top bit set and a hash of its eights,
    each mixed with its place, so that no polynomial identity makes two of them equal; who
    has to be sure compares the bytes (first_equals)."""
    lengths = (ends - starts).astype(np.int64)
    view = eights(data)
    short = lengths < 8
    out = np.empty(len(starts), U64)
    n = lengths[short]
    out[short] = (view[starts[short]] & TAILS[n]) | (n.astype(U64) << U64(56))
    if not short.all():
        n = lengths[~short]
        first, owner, nth, at = blocks_of(starts[~short], n)
        value = view[at] & TAILS[np.minimum(n[owner] - 8 * nth, 8)]
        h = np.add.reduceat(mix(value ^ mix(nth.astype(U64) + U64(BASE))), first)
        out[~short] = mix(h + n.astype(U64)) | LONG
    return out


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ranges of `lengths` bytes at a_at in a and at b_at in b are equal, byte for byte."""
    lengths = lengths.astype(np.int64)
    out = np.ones(len(lengths), bool)
    some = np.flatnonzero(lengths > 0)
    if len(some):
        n = lengths[some]
        first, owner, nth, at = blocks_of(a_at[some], n)
        differs = ((eights(a)[at] ^ eights(b)[b_at[some][owner] + 8 * nth]) & TAILS[np.minimum(n[owner] - 8 * nth, 8)]) != 0
        out[some] = np.add.reduceat(differs, first, dtype=np.int64) == 0
    return out


def first_equals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first range of each, number of each range's key) of distinct ranges, in no
    certain order. Ranges of equal key are compared byte for byte, and those that differ get
    numbers of their own under the same key."""
    found = pa.array(content_keys(data, starts, ends)).dictionary_encode()
    distinct, inverse = found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)
    first = np.empty(len(distinct), np.int64)
    first[inverse[::-1]] = np.arange(len(starts))[::-1]
    long = np.flatnonzero(ends - starts > 7)
    long = long[first[inverse[long]] != long]
    lead = first[inverse[long]]
    equal = (ends - starts)[long] == (ends - starts)[lead]
    equal[equal] = same_bytes(data, starts[long[equal]], data, starts[lead[equal]], (ends - starts)[long[equal]])
    if not equal.all():
        more: dict[bytes, int] = {}
        keys, firsts = [], []
        for k in long[~equal].tolist():
            body = data[starts[k] : ends[k]].tobytes()
            if body not in more:
                more[body] = len(distinct) + len(keys)
                keys.append(distinct[inverse[k]])
                firsts.append(k)
            inverse[k] = more[body]
        distinct, first = np.concatenate([distinct, np.array(keys, U64)]), np.concatenate([first, firsts])
    return distinct, first, inverse


def text_digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 hash of each whole row, which tell texts of one doc_id apart."""
    flat = data.tobytes()
    at = offsets.tolist()
    return np.frombuffer(b"".join(blake2b(flat[s:e], digest_size=8).digest() for s, e in zip(at, at[1:])), np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in runs of whole rows of about `most` bytes, with their text buffers.

    A row longer than that forms a run of its own, so no text is ever cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row_offsets) of the runs of bytes other than ASCII white space.

    Words of row r are those from row_offsets[r] to row_offsets[r + 1].
    """
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~SPACES[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(content_keys(data, starts, ends))


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row_offsets) of all k-grams inside rows; a row of fewer than
    k words, but at least one, has one shingle of all its words."""
    counts = np.diff(rows)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(per)])
    starts = np.arange(out[-1]) + np.repeat(rows[:-1] - out[:-1], per)
    ends = np.minimum(starts + k, np.repeat(rows[1:], per))
    return span_hash(prefix_sums(hashes), starts, ends), out


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each full window of the given width."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    best, span = np.arange(n), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: n - span - step + 1], best[step : n - span + 1]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same from starts[1] on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - at, counts)
