"""Substring deduplication by relative Lempel-Ziv parsing.

The texts that share repeated anchors form a reference block, indexed by its suffix array.
Each text is parsed greedily from left to right: the next factor is the longest match that
the block has, elsewhere, for what is left, found beside the place in the suffix array;
what matches nothing is a factor of one word. A factor of `least` words or more is a
duplicate span. A long match may also straddle the boundary of two factors, where the first
took its head. It can't straddle more (the factor that starts inside it reaches its end),
so wherever two neighbours together have `least` words, the starts before their boundary
are tried as well. That makes the result exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.repeats import Block, repeated_spans
from weftline.llm.textarrays import ranges


def parsed(block: Block, longest) -> tuple[np.ndarray, np.ndarray]:
    """(place, length of the match there) of all factors of all texts, in order; a factor
    of a word without a match has length 0. All texts advance together."""
    at = block.starts[:-1].copy()
    stop = block.starts[1:] - 1
    places, lengths = [], []
    at = at[at < stop]
    while len(at):
        n = longest(at)
        places.append(at)
        lengths.append(n)
        at = at + np.maximum(n, 1)
        at = at[at < block.ends[np.minimum(at, len(block.ends) - 1)]]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, n = np.concatenate(places), np.concatenate(lengths)
    order = np.argsort(p)
    return p[order], n[order]


def long_factors(block: Block, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of matches of `least` words or more, whose union is all that is repeated."""
    sa, rank = block.suffixes()
    sums = block.sums()

    def longest(at: np.ndarray, most: int | None = None) -> np.ndarray:
        r, out = rank[at], np.zeros(len(at), np.int64)
        for there, beside in ((r > 0, r - 1), (r + 1 < len(sa), r + 1)):
            out[there] = np.maximum(out[there], block.common(sums, at[there], sa[beside[there]], most))
        return out

    place, length = parsed(block, longest)
    long = length >= least
    joint = (block.ends[place[1:]] == block.ends[place[:-1]]) & (length[:-1] + length[1:] >= least) if len(place) else np.zeros(0, bool)
    i, j, far = place[:-1][joint], place[1:][joint], (place[1:] + length[1:])[joint]
    lo, hi = np.maximum(i + 1, j - least + 1), np.minimum(j, far - least + 1)
    tries = ranges(lo, np.maximum(0, hi - lo))
    # Beyond twice `least` words a match that straddles the boundary lies in the second factor.
    n = longest(tries, 2 * least)
    good = n >= least
    return np.concatenate([place[long], tries[good]]), np.concatenate([length[long], n[good]])


def duplicate_spans(spark: SparkSession, docs: DataFrame, least: int = 50) -> DataFrame:
    """Ranges of words that occur elsewhere, by RLZ parsing; see repeats.repeated_spans for
    the columns and for nulls, short texts, repeated rows and empty tables."""
    return repeated_spans(spark, docs, long_factors, least)
