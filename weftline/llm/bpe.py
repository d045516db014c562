"""Byte-level BPE encoding and decoding with segment trees over pair ranks.

The pieces of a text (words with their leading space, numbers, runs of signs, white space)
are found by comparing the character classes of neighbouring characters, for a whole
buffer at once. Each distinct piece is merged once in a worker's life: the ranks of its
adjacent pairs are the leaves of a segment tree of minima, keyed by rank and then place, so the root is the leftmost pair of lowest rank; a merge changes three leaves, and each
change goes up one path of the tree. Merging ends when the root says that no pair can be
merged. Trees of one size are kept as rows of one matrix and advance together.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.plumbing import small_batches
from weftline.llm.textarrays import U64, first_equals, mix, pieces, ranges, same_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NO_PAIR = np.int64(2**62)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CACHE_BYTES = 48 << 20


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


class Vocabulary:
    """Token bytes by id, and for each pair of ids that may be merged the id of the result."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 24 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.shift = U64(64 - (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)  # open addressing
        self.merged = np.full(len(self.keys), NO_PAIR, np.int64)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = (mix(keys.view(U64)) >> self.shift).astype(np.int64)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.merged[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_PAIR where the pair can't be merged."""
        key = left << 24 | right
        at = (mix(key.view(U64)) >> self.shift).astype(np.int64)
        out = np.full(len(key), NO_PAIR, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge(voc: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all pieces in order, tokens of each piece); pieces have at least a byte."""
    n = len(starts)
    ids: list = [None] * n
    size = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
    counts = np.ones(n, np.int64)
    order, groups = np.argsort(size, kind="stable"), []
    for leaves in np.unique(size).tolist():
        group = order[np.searchsorted(size[order], leaves) : np.searchsorted(size[order], leaves, "right")]
        each = max(1, (1 << 18) // leaves)
        groups += [(leaves, group[i : i + each]) for i in range(0, len(group), each)]
    flat = []
    for leaves, group in groups:
        m, width = len(group), lengths[group]
        cell = np.arange(leaves)
        real = cell < width[:, None]
        tok = np.full((m, leaves), -1, np.int64)
        tok[real] = voc.of_byte[data[ranges(starts[group], width)]]
        nxt, prv = np.broadcast_to(cell + 1, (m, leaves)).copy(), np.broadcast_to(cell - 1, (m, leaves)).copy()
        tree = np.full((m, 2 * leaves), NO_PAIR, np.int64)
        r, c = np.nonzero(real[:, 1:])
        pair = voc.rank(tok[r, c], tok[r, c + 1])
        tree[r, leaves + c] = np.where(pair < NO_PAIR, pair * leaves + c, NO_PAIR)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(row):
            at = tree[row, 1] % leaves
            tok[row, at] = tree[row, 1] // leaves  # the rank of a pair is the id of its merge
            gone = nxt[row, at]
            after = nxt[row, gone]
            tok[row, gone] = -1
            nxt[row, at] = after
            inner = after < width[row]
            prv[row[inner], after[inner]] = at[inner]
            before = prv[row, at]
            has = before >= 0
            rr = np.concatenate([row, row, row[has]])
            cc = np.concatenate([gone, at, before[has]])
            new = np.full(len(rr), NO_PAIR, np.int64)
            k = len(row)
            some = np.flatnonzero(inner)
            left_at, right_at = np.concatenate([at[some], before[has]]), np.concatenate([after[some], at[has]])
            rows2 = np.concatenate([row[some], row[has]])
            pair = voc.rank(tok[rows2, left_at], tok[rows2, right_at])
            pair = np.where(pair < NO_PAIR, pair * leaves + left_at, NO_PAIR)
            new[k + some] = pair[: len(some)]
            new[2 * k :] = pair[len(some) :]
            cc = cc + leaves
            tree[rr, cc] = new
            while leaves > 1 and cc[0] > 1:
                cc = cc >> 1
                tree[rr, cc] = np.minimum(tree[rr, 2 * cc], tree[rr, 2 * cc + 1])
            row = row[tree[row, 1] < NO_PAIR]
        live = tok >= 0
        counts[group] = live.sum(axis=1)
        flat.append(tok[live])
    where = np.concatenate([g for _, g in groups]) if groups else np.zeros(0, np.int64)
    out_at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    if groups:
        out[ranges(out_at[where], counts[where])] = np.concatenate(flat)
    return out, counts


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets at which pieces start, offsets of each row in that list).

    Pieces are: the English contractions 's 't 'm 'd 'll 've 're; letters, numbers or other
    signs, each run with one space before it; white space, of which a run leaves its last
    character to what follows. No piece spans two rows. The bytes are valid UTF-8.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = character_classes()
    if len(at) == n:
        kind, code = kinds[data], data
    else:
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = kinds[code]
    m = len(at)
    first = np.zeros(m + 1, bool)
    first[np.searchsorted(at, offsets)] = True  # row starts
    edge = first[:m].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    start = edge.copy()
    space = kind == SPACE
    # A run of white space that something follows gives up its last character: a plain
    # space starts the next piece, any other stands alone.
    end = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:m]) if m > 1 else np.zeros(0, np.int64)
    start[end] = True
    plain = end[code[end] == 32]
    start[plain + 1] = False
    # Contractions: an apostrophe that starts a piece, with its letters.
    quote = np.flatnonzero((code == 39) & start)
    row_end = np.append(np.flatnonzero(first[:m]), m)
    if len(quote):
        last = row_end[np.searchsorted(row_end, quote, "right")]
        low = np.concatenate([code, np.zeros(3, code.dtype)])
        a, b = low[quote + 1], low[quote + 2]
        one = (quote + 1 < last) & np.isin(a, [ord(x) for x in "stmd"])
        two = (quote + 2 < last) & (((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101)))
        for q, stop in zip(quote[one | two].tolist(), np.where(one, quote + 2, quote + 3)[one | two].tolist()):
            if start[q]:
                start[q + 1 : stop] = False
                if stop < m:
                    start[stop] = True
    # A sign run that goes on after an apostrophe pair needs no rule: the apostrophe begins a piece only at its start.
    pos = at[start]
    return pos, np.searchsorted(pos, offsets)


class Encoder:
    """Encodes buffers of texts; distinct pieces are merged once and then remembered,
    in sorted arrays that are dropped when they outgrow CACHE_BYTES. Pieces are the same
    only if their bytes are: where a key doesn't hold them all, they are compared."""

    def __init__(self, path: str):
        self.voc = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.count = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text_at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.text = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def remembered(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the memory, whether that is the same piece, byte for byte)."""
        slot = np.searchsorted(self.known, keys)
        hit = slot < len(self.known)
        hit[hit] = self.known[slot[hit]] == keys[hit]
        long = np.flatnonzero(hit & (sizes > 7))
        equal = self.size[slot[long]] == sizes[long]
        some = long[equal]
        equal[equal] = same_bytes(data, starts[some], self.text, self.text_at[slot[some]], sizes[some])
        hit[long] = equal
        return slot, hit

    def remember(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Adds pieces; of those with equal keys the first alone."""
        slot = np.searchsorted(self.known, keys)
        there = slot < len(self.known)
        there[there] = self.known[slot[there]] == keys[there]
        new = np.zeros(len(keys), bool)
        new[np.unique(keys, return_index=True)[1]] = True
        new &= ~there
        keys, starts, sizes, at, count = keys[new], starts[new], sizes[new], at[new], count[new]
        held = np.where(sizes > 7, sizes, 0)
        text_at = len(self.text) + np.cumsum(held) - held
        self.text = np.concatenate([self.text, data[ranges(starts, held)]])
        order = np.argsort(np.concatenate([self.known, keys]), kind="stable")
        self.known, self.at, self.count, self.text_at, self.size = (np.concatenate(x)[order] for x in ((self.known, keys), (self.at, at), (self.count, count), (self.text_at, text_at), (self.size, sizes)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, row offsets)."""
        pos, rows = piece_starts(data, offsets)
        if not len(pos):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(pos[1:], len(data))
        keys, first, inverse = first_equals(data, pos, ends)
        starts, sizes = pos[first], (ends - pos)[first]
        slot, known = self.remembered(keys, data, starts, sizes)
        at, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        at[known], count[known] = self.at[slot[known]], self.count[slot[known]]
        new = np.flatnonzero(~known)
        pool = self.ids
        if len(new):
            ids, counts = merge(self.voc, data, starts[new], sizes[new])
            at[new], count[new] = len(pool) + np.cumsum(counts) - counts, counts
            self.ids = pool = np.concatenate([pool, ids])
            self.remember(keys[new], data, starts[new], sizes[new], at[new], count[new])
            if self.known.nbytes * 5 + self.ids.nbytes + self.text.nbytes > CACHE_BYTES:
                self.forget()
        n = count[inverse]
        total = np.concatenate([[0], np.cumsum(n)])
        return pool[ranges(at[inverse], n)], total[rows]


def decode(voc: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that the ids stand for, one after the other."""
    return voc.bytes[ranges(voc.starts[ids], voc.lengths[ids])]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def on_worker(path: str) -> str:
    """A path of the driver, or the name of a file shipped with SparkContext.addFile."""
    return path if "/" in path else SparkFiles.get(path)


def encoded(docs: DataFrame, path: str = VOCABULARY, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, and tokens (array<int>), n_tokens and round_trip of every row.

    round_trip says that decoding the tokens gave the text's bytes again. The strings of
    special tokens are ordinary text. A null text has null tokens, n_tokens and round_trip;
    an empty one an empty array, a very long one a long array. Other columns are not read; the kept ones pass through,
    nulls and repeated rows included; an empty table gives no rows. `path` is a file that
    every worker can read, or the bare name of one added with SparkContext.addFile.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(on_worker(path))
        for batch, data, offsets in pieces(batches, "weft_text"):
            ids, at = enc.encode(data, offsets)
            back = decode(enc.voc, ids)
            sizes = np.concatenate([[0], np.cumsum(enc.voc.lengths[ids])])[at]
            good = np.diff(sizes) == np.diff(offsets)
            if len(back) == len(data):
                wrong = np.flatnonzero(back != data)
                good[np.searchsorted(offsets, wrong, "right") - 1] = False
            else:
                good = np.array([np.array_equal(back[sizes[i] : sizes[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(good))])
            null = batch.column(batch.num_columns - 1).is_null().to_numpy(zero_copy_only=False)
            cells = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(null, False)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cells, pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(good, mask=null)], names)

    small_batches(docs.sparkSession)
    source = docs.select(*[docs[c] for c in keep], docs[text_column].cast("string").alias("weft_text"))
    fields = [*source.schema.fields[:-1]]
    names = [*[f.name for f in fields], "tokens", "n_tokens", "round_trip"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens array<int>, n_tokens int, round_trip boolean"])
    return source.mapInArrow(rows, schema)


def decoded(tokens: DataFrame, path: str = VOCABULARY, column: str = "tokens", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and the text of each row's tokens. Null tokens give a null text,
    no tokens an empty one; ids outside the vocabulary are an error; bytes that aren't UTF-8
    become replacement characters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = encoder(on_worker(path)).voc
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [None if x is None else decode(voc, np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    source = tokens.select(*[tokens[c] for c in keep], tokens[column].alias("weft_tokens"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "text string"])
    return source.mapInArrow(rows, schema)
