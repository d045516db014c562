"""Substring deduplication with a run-length compressed Burrows-Wheeler index.

The texts that share repeated anchors are indexed by their BWT, kept as runs: for each run
its word, where it starts, where the step to the left (LF) takes its start, and how far the
suffixes to which its two ends step match their neighbours. Nothing else is kept; the suffix
array is needed to make these and then dropped.

Matching statistics are streamed over the runs. Every text is read from its end to its
beginning, all texts at once: a place in the BWT steps to the place of the suffix one word
longer, linearly within its run. Where it isn't at the edge of a run, it and its neighbour
in suffix order are preceded by the same word, so the neighbour steps along and their match
grows by one; at an edge the sampled match takes over. The longer of the matches with the
suffix before and the suffix after is the longest match elsewhere; those of `least` words or
more mark duplicate spans. In repetitive text runs, and so samples, are few.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.repeats import Block, repeated_spans


class RunLengthIndex:
    """heads, run_starts, run_ends: the runs of the BWT. steps: LF of each run's start. before
    (after): the match of the suffix at LF of the run's start (end) with the suffix before
    (after) it."""

    def __init__(self, block: Block):
        tokens = block.tokens
        self.n = n = len(tokens)
        self.n_texts = len(block.starts) - 1
        sa, rank = block.suffixes()
        bwt = tokens[sa - 1] if n else tokens
        change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.run_starts = np.concatenate([[0], change]) if n else np.zeros(0, np.int64)
        self.heads = bwt[self.run_starts]
        self.run_ends = np.append(self.run_starts[1:], n)[: len(self.run_starts)] - 1
        sums = block.sums()
        samples = []
        for edge, step in ((self.run_starts, -1), (self.run_ends, 1)):
            at = (sa[edge] - 1) % max(n, 1)
            beside = rank[at] + step
            ok = (beside >= 0) & (beside < n)
            lcp = np.zeros(len(at), np.int64)
            lcp[ok] = block.common(sums, at[ok], sa[beside[ok]])
            samples.append(lcp)
        self.before, self.after = samples
        # For LF and for counting: for each word its runs in order, and how many of it come before each.
        order = np.argsort(self.heads, kind="stable")
        self.size = (self.run_ends - self.run_starts + 1)[order]
        self.by_head, self.by_start = self.heads[order], self.run_starts[order]
        self.lesser = np.cumsum(self.size) - self.size
        self.steps = np.empty(len(order), np.int64)
        self.steps[order] = self.lesser

    def statistics(self, starts: np.ndarray) -> np.ndarray:
        """Longest match elsewhere of the suffix at each place; starts are those of the texts,
        with the end of the last."""
        out = np.zeros(self.n, np.int64)
        x, first = starts[1:] - 1, starts[:-1]
        # The end marks are the greatest words, in the order of the texts.
        place = self.n - self.n_texts + np.arange(self.n_texts)
        before, after = np.zeros(self.n_texts, np.int64), np.zeros(self.n_texts, np.int64)
        while True:
            on = x > first
            if not on.all():
                x, first, place, before, after = x[on], first[on], place[on], before[on], after[on]
            if not len(x):
                return out
            run = np.searchsorted(self.run_starts, place, "right") - 1
            before = np.where(place == self.run_starts[run], self.before[run], before + 1)
            after = np.where(place == self.run_ends[run], self.after[run], after + 1)
            place = self.steps[run] + place - self.run_starts[run]
            x = x - 1
            out[x] = np.maximum(before, after)

    def rank(self, word: int, end: int) -> int:
        """Occurrences of word in BWT[:end], plus those of lesser words in all of it."""
        lo, hi = np.searchsorted(self.by_head, word), np.searchsorted(self.by_head, word, "right")
        k = int(np.searchsorted(self.by_start[lo:hi], end)) + lo
        if k == lo:
            return int(self.lesser[lo]) if lo < len(self.lesser) else self.n
        return int(self.lesser[k - 1] + min(self.size[k - 1], end - self.by_start[k - 1]))

    def count(self, pattern: list[int]) -> int:
        """Occurrences of a sequence of words, by backward search."""
        lo, hi = 0, self.n
        for word in reversed(pattern):
            lo, hi = self.rank(word, lo), self.rank(word, hi)
            if lo >= hi:
                return 0
        return hi - lo


def long_matches(block: Block, least: int) -> tuple[np.ndarray, np.ndarray]:
    found = RunLengthIndex(block).statistics(block.starts)
    places = np.flatnonzero(found >= least)
    return places, found[places]


def duplicate_spans(spark: SparkSession, docs: DataFrame, least: int = 50) -> DataFrame:
    """Ranges of words that occur elsewhere, by the run-length index; see
    repeats.repeated_spans for the columns and for nulls, short texts, repeated rows and
    empty tables."""
    return repeated_spans(spark, docs, long_matches, least)
