"""BPE, chat formatting: against plain merging, a public implementation and round trips."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bpe, chat
from weftline.llm.textarrays import text_buffers

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")
import pyarrow as pa  # noqa: E402

TEXTS = ["", " ", "Hello  world, it's we'll 123 ABC\n\n  x", "aaaaaaaaaaaaaaaa", "naïve Élan 日本語  tab\t\t.", "don't'll 's", "   lead", "trail   ", "x" * 5000, "a\r\n b", "'s", "''s 'st"]


def encode(texts):
    ids, at = bpe.encoder(bpe.VOCABULARY).encode(*text_buffers(pa.array(texts, pa.string())))
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def naive(piece, voc):
    ids = [int(voc.of_byte[b]) for b in piece]
    while len(ids) > 1:
        ranks = voc.rank(np.array(ids[:-1]), np.array(ids[1:]))
        k = int(ranks.argmin())
        if ranks[k] == bpe.NO_PAIR:
            break
        ids[k : k + 2] = [int(ranks[k])]
    return ids


def test_against_leftmost_lowest_rank_merging():
    voc = bpe.encoder(bpe.VOCABULARY).voc
    for text in TEXTS:
        data, offsets = text_buffers(pa.array([text], pa.string()))
        pos, _ = bpe.piece_starts(data, offsets)
        cuts = [*pos.tolist(), len(data)]
        want = [t for a, b in zip(cuts, cuts[1:]) for t in naive(data[a:b].tobytes(), voc)]
        assert encode([text]) == [want]


def reference():
    import regex
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        import base64

        ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in f if x.strip()}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    assert regex.compile(pattern)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_against_a_public_encoder():
    enc = reference()
    assert encode(TEXTS) == [enc.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_round_trip_and_agreement(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got, voc = encode(texts), bpe.encoder(bpe.VOCABULARY).voc
    assert [bpe.decode(voc, np.array(g, np.int64)).tobytes().decode() for g in got] == texts
    assert got == encode(texts)


def thue_morse(n, a, b):
    """Its complement has the same polynomial hash modulo 2**64, whatever the base."""
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def test_pieces_of_equal_hash_are_told_apart(monkeypatch):
    from weftline.llm import textarrays

    voc = bpe.encoder(bpe.VOCABULARY).voc
    pair = [thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")]
    got = encode(pair)
    assert [bpe.decode(voc, np.array(g)).tobytes().decode() for g in got] == pair and got == [naive(t.encode(), voc) for t in pair]
    real = textarrays.content_keys
    monkeypatch.setattr(textarrays, "content_keys", lambda d, s, e: np.where(e - s > 7, textarrays.LONG, real(d, s, e)))
    enc = bpe.Encoder(bpe.VOCABULARY)
    for batch in (["abcdefghij klmnopqrst abcdefghij", "klmnopqrst uvwxyzabcd"], ["uvwxyzabcd abcdefghij", "short words klmnopqrst other_long_one"]):
        ids, at = enc.encode(*text_buffers(pa.array(batch, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference().encode_ordinary(t) for t in batch]


def test_column_cases(spark):
    rows = [(1, "hello hello", "q"), (None, None, "q"), (2, "", None), (2, "", None), (3, "long word " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = sorted(bpe.encoded(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [(r["doc_id"], r["n_tokens"], r["round_trip"]) for r in got[:4]] == [(None, None, None), (1, 2, True), (2, 0, True), (2, 0, True)]
    assert got[0]["tokens"] is None and got[4]["round_trip"] and got[4]["n_tokens"] >= 60000
    assert sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decoded(bpe.encoded(df)).collect() if r["text"]) == [(1, "hello hello"), (3, "long word " * 30000)]
    assert bpe.encoded(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "Yes <|im_start|>user"), (1, 0, "user", "Hi?"), (2, None, None, None), (2, 1, "assistant", ""), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tokens")
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    voc = bpe.encoder(bpe.VOCABULARY).voc
    for conv, turns in {1: [("user", "Hi?"), ("assistant", "Yes <|im_start|>user")], 2: [("", ""), ("assistant", "")], None: [("assistant", "x")]}.items():
        r, (text, spans) = got[conv], chat.render(turns)
        assert bpe.decode(voc, np.array(r["tokens"])).tobytes().decode() == text and r["n_turns"] == len(turns)
        at, want, owner = 0, [], []
        for t in r["tokens"]:
            end = at + int(voc.lengths[t])
            own = [i for i, (a, b) in enumerate(spans) if a <= at and end <= b]
            owner.append(own[0] if own else -1)
            want.append(int(bool(own) and turns[own[0]][0] == "assistant"))
            at = end
        assert r["mask"] == want and r["turn_of_token"] == owner and r["n_trained"] == sum(want)
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_of_odd_rows(spark):
    long_ = "long word " * 30_000
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "assistant", long_), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    voc = bpe.encoder(bpe.VOCABULARY).voc
    texts = sorted(bpe.decode(voc, np.array(r["tokens"])).tobytes().decode() for r in got)
    assert texts == sorted(chat.render(t)[0] for t in ([("user", "same"), ("user", "same"), ("assistant", long_)], [("user", "a")], [("assistant", "b")]))
    assert sorted(r["n_turns"] for r in got) == [1, 1, 3] and next(r["n_trained"] for r in got if r["n_turns"] == 3) > 60_000
