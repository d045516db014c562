"""Repeated spans by both indexes, against brute force over all windows."""

import random

import pytest

from weftline.llm import lempelziv, repeats, runindex

LEAST = 20


def brute(rows, least):
    texts = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    seen = {}
    for k, (_, t) in enumerate(texts):
        w = t.split()
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((k, i))
    cover = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k].update(range(i, i + least))
    out = []
    for (d, _), c in zip(texts, cover):
        start = None
        for i in sorted(c):
            if i - 1 not in c:
                start = i
            if i + 1 not in c:
                out.append((d, start, i + 1, i + 1 - start))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh")
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    shared = [fresh(rng.randint(15, 40)) for _ in range(5)]
    rows = []
    for d in range(30):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(shared)[rng.randint(0, 3) :] if rng.random() < 0.6 else fresh(rng.randint(1, 30))
        rows.append((d, " ".join(parts)))
    rows += [(40, " ".join(["x"] * 70)), (41, " ".join(["x", "y"] * 40)), (42, " ".join(word() for _ in range(400)))]
    rows += [(50, rows[3][1]), (50, rows[4][1]), (51, rows[3][1]), (51, rows[3][1]), (60, None), (None, rows[3][1]), (61, ""), (62, "\n".join(f"w{i}" for i in range(30000)))]
    return rows


@pytest.mark.parametrize("engine", [lempelziv, runindex], ids=["rlz", "rlbwt"])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans(spark, engine, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, s string").withColumnRenamed("s", "runs")
    got = sorted(map(tuple, engine.duplicate_spans(spark, df.repartition(3), LEAST).collect()))
    assert got == brute(rows, LEAST)


@pytest.mark.parametrize("engine", [lempelziv.long_factors, runindex.long_matches], ids=["rlz", "rlbwt"])
def test_crowded_anchors(spark, engine):
    """With hot = 1 every anchor of differing surroundings is settled window by window."""
    rows = corpus(3)
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, repeats.repeated_spans(spark, df, engine, LEAST, hot=1).collect()))
    assert got == brute(rows, LEAST)


def thue_morse(n, a, b, sep=""):
    return sep.join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


@pytest.mark.parametrize("engine", [lempelziv, runindex], ids=["rlz", "rlbwt"])
def test_what_only_hashes_alike_is_told_apart(spark, engine, monkeypatch):
    """Complementary Thue-Morse sequences, of letters in a word and of words in a text, have
    equal polynomial hashes modulo 2**64 for every base."""
    before, after = " ".join(f"l{i}" for i in range(20)), " ".join(f"r{i}" for i in range(19))
    one, other = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    rows = [(1, f"{before} {one} {after}"), (2, f"{before} {other} {after}"), (3, f"p {thue_morse(4096, 'a', 'b', ' ')} q"), (4, f"p {thue_morse(4096, 'b', 'a', ' ')} q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    least = 30
    got = sorted(map(tuple, engine.duplicate_spans(spark, df, least).collect()))
    assert got == brute(rows, least) and {r[0] for r in got} == {3, 4}


def test_words_of_equal_key_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from weftline.llm import textarrays

    real = textarrays.content_keys
    monkeypatch.setattr(textarrays, "content_keys", lambda d, s, e: np.where(e - s > 7, textarrays.LONG, real(d, s, e)))
    texts = [b"abcdefgh x ijklmnop x", b"ijklmnop x abcdefgh x"]
    block = repeats.Block(np.arange(2), np.zeros(2, np.int64), np.zeros(2, np.int64), pa.array(texts, pa.binary()))
    seq = block.tokens.tolist()
    assert seq[0] == seq[7] != seq[2] == seq[5] and len(set(seq)) == 5


def test_common_prefixes_are_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = [b"a b c d e f", b"a b c x e f", b"a b"]
    block = repeats.Block(np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64), pa.array(texts, pa.binary()))
    nothing = np.zeros(len(block.tokens) + 1, np.uint64)  # every hash equal
    a, b = np.array([0, 0, 2, 4, 1]), np.array([7, 14, 9, 11, 7])
    for size in (1 << 20, 3):
        monkeypatch.setattr(repeats, "COMPARED", size)
        assert block.common(nothing, a, b).tolist() == [3, 2, 1, 2, 0] and block.common(nothing, a, b, 1).tolist() == [1, 1, 1, 1, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lempelziv.duplicate_spans(spark, df).count() == 0 and runindex.duplicate_spans(spark, df).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(spark, df, lempelziv.long_factors, 5)


def test_run_index_counts_patterns():
    import numpy as np
    import pyarrow as pa

    texts = ["a b a b a c", "a b", "c c c"]
    n = len(texts)
    block = repeats.Block(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), pa.array([t.encode() for t in texts], pa.binary()))
    index = runindex.RunLengthIndex(block)
    seq = block.tokens.tolist()
    for i in range(len(seq)):
        for k in (1, 2, 3):
            pattern = seq[i : i + k]
            assert index.count(pattern) == sum(seq[j : j + len(pattern)] == pattern for j in range(len(seq) - len(pattern) + 1))
    assert len(index.heads) <= len(seq)


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_against_plain_loops(seed):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab" if seed % 2 else "abcdef") for _ in range(rng.randint(1, 25))) for _ in range(6)] + ["a b " * 10, "a", "a b " * 10]
    n = len(texts)
    block = repeats.Block(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), pa.array([t.encode() for t in texts], pa.binary()))
    seq, want = block.tokens.tolist(), []
    for i in range(len(seq)):
        best = 0
        for j in range(len(seq)):
            k = 0
            while j != i and i + k < block.ends[i] and j + k < block.ends[j] and seq[i + k] == seq[j + k]:
                k += 1
            best = max(best, k)
        want.append(best)
    assert runindex.RunLengthIndex(block).statistics(block.starts).tolist() == want


def test_factors_cover_the_text():
    import numpy as np
    import pyarrow as pa

    texts = [b"a b c d a b c d e", b"a b c d", b"q"]
    block = repeats.Block(np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64), pa.array(texts, pa.binary()))
    seq = block.tokens.tolist()

    def longest(at):
        out = []
        for i in at.tolist():
            best = 0
            for j in range(len(seq)):
                k = 0
                while j != i and i + k < block.ends[i] and j + k < block.ends[j] and seq[i + k] == seq[j + k]:
                    k += 1
                best = max(best, k)
            out.append(best)
        return np.array(out, np.int64)

    place, length = lempelziv.parsed(block, longest)
    assert place.tolist() == [0, 4, 8, 10, 15] and length.tolist() == [4, 4, 0, 4, 0]
