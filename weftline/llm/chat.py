"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once, and each token's byte span is set against
the byte spans of the turns: both are sorted, so a binary search finds each token's turns.
A token counts for training if it lies in the text (or the closing mark) of a turn of a
trained role; a token that straddles the edge of such a span does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import VOCABULARY, encoder, on_worker
from weftline.llm.plumbing import small_batches
from weftline.llm.textarrays import text_buffers

OPEN, MIDDLE, CLOSE, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, byte span of each turn's content with its closing mark)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{role}{MIDDLE}", f"{text}{CLOSE}"
        start = at + len(head.encode())
        end = start + len(body.encode())
        spans.append((start, end))
        parts += [head, body, AFTER]
        at = end + len(AFTER)
    return "".join(parts), spans


def token_turns(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The turn whose span holds each token whole, or -1; spans are sorted and disjoint."""
    if not len(spans):
        return np.full(len(starts), -1)
    k = np.searchsorted(spans[:, 0], starts, "right") - 1
    inside = (k >= 0) & (ends <= spans[np.maximum(k, 0), 1])
    return np.where(inside, k, -1)


def formatted(conversations: DataFrame, path: str = VOCABULARY, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, tokens, mask, turn_of_token, n_trained) of every conversation.

    Turns are in order of turn, then role, then text; a null turn comes first. Rows that
    repeat a turn are turns of their own. A null role is rendered as an empty one and never
    trained, a null text as an empty one. Marks are ordinary text to the tokenizer, so a
    text that contains them can't forge a turn: spans come from the rendering alone. A row
    with a null conv_id is a conversation of its own, for nothing says what it belongs to. A
    very long text is rendered and encoded whole. Other columns are not read; an empty table
    gives no rows. A conversation is gathered in one task, which its one rendering needs.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(on_worker(path))
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, 512):
                convs = batch.column(1).slice(lo, 512).to_pylist()
                texts, spans = zip(*(render([(t["role"] or "", t["text"] or "") for t in c]) for c in convs))
                data, offsets = text_buffers(pa.array(texts, pa.string()))
                tokens, at = enc.encode(data, offsets)
                edges = np.concatenate([[0], np.cumsum(enc.voc.lengths[tokens])])
                turns = np.empty(len(tokens), np.int32)
                mask = np.zeros(len(tokens), np.int8)
                for i, c in enumerate(convs):
                    a, b = at[i], at[i + 1]
                    t = token_turns(edges[a:b] - edges[a], edges[a + 1 : b + 1] - edges[a], np.array(spans[i], np.int64).reshape(-1, 2))
                    turns[a:b] = t
                    good = np.array([x["role"] in trained for x in c] + [False])
                    mask[a:b] = good[t]
                n_trained = np.add.reduceat(np.append(mask, 0).astype(np.int64), at[:-1]) if len(convs) else np.zeros(0, np.int64)
                cells = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (tokens, mask, turns)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512), pa.array([len(c) for c in convs], pa.int32()), *cells, pa.array(n_trained)], ["conv_id", "n_turns", "tokens", "mask", "turn_of_token", "n_trained"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    small_batches(conversations.sparkSession)
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(turns.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    return whole.mapInArrow(rows, "conv_id long, n_turns int, tokens array<int>, mask array<tinyint>, turn_of_token array<int>, n_trained long")
