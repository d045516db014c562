"""Secret scan: the dynamic program against all segmentations, and the scan's cases."""

import base64
import math
import os
import time
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import guesses

needs_vocabulary = pytest.mark.skipif(not os.path.exists(guesses.VOCABULARY), reason="no vocabulary files")


WORDS = {"password": 1, "dragon": 2, "love": 3, "qwerty": 4}
KEYBOARD = ["`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", "  zxcvbnm,./"]


def neighbours(a, b):
    """Direction of a step between keys that touch, on rows set off by a half, three quarters and five quarters of a key."""
    off, at = [0, -0.5, -0.25, -0.75], {}
    for y, row in enumerate(KEYBOARD):
        for x, c in enumerate(row):
            at[c] = (x + off[y], y)
    (x1, y1), (x2, y2) = at.get(a, (99, 99)), at.get(b, (-99, 99))
    return (x2 > x1, y2 - y1) if a != b and abs(y1 - y2) <= 1 and abs(x1 - x2) <= 1.01 else None


def all_spans(value):
    """(start, end, cost) of every span of every kind, found by plain loops, without the operator's own generators."""
    n = len(value)
    for i in range(n):
        for j in range(i + 1, n + 1):
            span = value[i:j]
            yield i, j, float(j - i)
            for word, rank in WORDS.items():
                if span.lower() == word or span.lower().translate(str.maketrans("4@301!$57", "aaeoiisst")) == word:
                    caps = sum(c.isupper() for c in span)
                    twice = (0 if not caps else 1 if caps == len(span) or (caps == 1 and span[0].isupper()) else min(caps, len(span) - caps) + 1) + (span.lower() != word)
                    yield i, j, math.log10(rank) + twice * math.log10(2)
            for y, m, d, sep in ((span[:4], span[5:7], span[8:], span[4:5] == span[7:8] in ("-", "/", ".")), (span[4:], span[2:4], span[:2], False)):
                if len(span) == (10 if sep else 8) and (y + m + d).isdigit() and 1000 <= int(y) <= 2100 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
                    yield i, j, math.log10(max(20, abs(int(y) - 2025)) * 365 * (4 if sep else 1))
            for p in range(1, len(span) // 2 + 1):
                unit = span[:p]
                if len(span) > 2 and unit * (len(span) // p) == span and not any(unit == unit[:q] * (p // q) for q in range(1, p) if p % q == 0):
                    yield i, j, exhaustive(unit) + math.log10(len(span) // p)
            steps = [neighbours(a, b) for a, b in zip(span, span[1:])]
            if len(steps) > 1 and None not in steps:
                turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
                yield i, j, math.log10(47) + turns * math.log10(9.2) + (len(steps) - turns) * math.log10(1.25)


@lru_cache(None)
def exhaustive(value):
    """Least cost over all segmentations, by recursion over the last span."""
    spans = list(all_spans(value)) if value else []

    @lru_cache(None)
    def upto(end):
        if not end:
            return 0.0
        return min((upto(i) + (math.log10(4) if i else 0.0) + c for i, j, c in spans if j == end), default=math.inf)

    return upto(len(value))


@pytest.fixture(scope="module")
def words(tmp_path_factory):
    """A vocabulary file without words; the operator's first list is WORDS."""
    at = tmp_path_factory.mktemp("voc") / "none.tiktoken"
    at.write_text(base64.b64encode(b"x").decode() + " 0\n")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(guesses, "FIRST", list(WORDS))
        guesses.dictionary(str(at))  # kept by path
    return str(at)


@pytest.mark.parametrize("value", ["password", "P4ssw0rd", "qwerty12", "aaaaaa", "abcabcab", "2019-01-02", "x7Kq", "love1999", "zxcvbn1", "01021999", "xlovelovelove", "dragon11", "dpasswordpassword", "abaabaabaaba", "aaaabaaaabaaaabaa", "kloveloveklovelovek", "asdsasdsasds", "qazwsxqazwsxqaz", "ababababaXababab", "xyzxyzxyz1234567890", "loveaaaaalove"])
def test_least_cost(words, value):
    assert all(guesses.dictionary(words)[0][w] == r for w, r in WORDS.items())
    assert guesses.cost(value, words)[0] == pytest.approx(exhaustive(value), abs=1e-9)
    assert "".join(s for _, s in guesses.cost(value, words)[1]) == value


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=22) | st.text("aslove12", max_size=16) | st.text("abc", min_size=1, max_size=6).map(lambda u: ("z" + u * 4 + u[:2])[:26]))
def test_least_cost_of_any_value(words, value):
    assert guesses.cost(value, words)[0] == pytest.approx(exhaustive(value), abs=1e-9)


@given(st.text("aab", max_size=40))
def test_runs(value):
    n, want = len(value), set()
    for p in range(1, n // 2 + 1):
        for s in range(n - 2 * p + 1):
            e = s + p
            while e < n and value[e] == value[e - p]:
                e += 1
            unit = value[s : s + p]
            if e - s >= 2 * p and (s == 0 or value[s - 1] != value[s - 1 + p]) and not any(unit == unit[:q] * (p // q) for q in range(1, p) if p % q == 0):
                want.add((s, e, p))
    assert set(guesses.periodic_runs(value)) == want


@needs_vocabulary
def test_kinds():
    kinds = lambda v: [k for k, _ in guesses.cost(v)[1]]
    assert kinds("password") == ["word"] and kinds("31-12-1999") == ["date"] and kinds("aaaaaaaa") == ["repeat"] and kinds("qwertyuiop") == ["walk"]
    assert kinds("k9$Vw2#pLz") == ["brute"] and guesses.cost("")[0] == 0
    assert guesses.cost("password")[0] < 2 < 9 < guesses.cost("k9$Vw2#pLz")[0]
    for weak in ("basketball", "everything", "your_password_here", "mypassphrase", "Basketball1", "9a8b7c6d9"):
        assert guesses.cost(weak)[0] < 10


@needs_vocabulary
@pytest.mark.parametrize("value", ["the quick brown fox " * 1000, "a" * 20000, "Zq" * 10000, "".join(chr(33 + (i * i * 7 + i // 3) % 90) for i in range(20000)), "asdsa" * 4000, "a" * 10000 + "k9$Vw2#pLz" * 1000])
def test_long_values_take_little_time(value):
    guesses.dictionary(guesses.VOCABULARY)
    began = time.process_time()
    assert "".join(s for _, s in guesses.cost(value)[1]) == value
    assert time.process_time() - began < 2


@needs_vocabulary
def test_scan(spark):
    rows = [
        (1, 'set password = "correct" and api_key: k9$Vw2#pLzQ8rT5 then'),
        (1, "password: correct"),
        (2, None),
        (3, ""),
        (None, "token=abcdefgh1234XYZq"),
        (4, "no secrets here, the password is long"),
        (5, "x" * 200000 + " client-secret='p q r s t u v w'"),
    ]
    df = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, text string, value string")
    got = {(r["doc_id"], r["name"]): r for r in guesses.secrets(df).collect()}
    assert set(got) == {(1, "password"), (1, "api_key"), (None, "token"), (5, "client-secret")}
    assert got[1, "password"]["n"] == 2 and not got[1, "password"]["is_secret"]
    assert got[1, "api_key"]["is_secret"] and got[1, "api_key"]["value"] == "k9$Vw2#pLzQ8rT5" and got[5, "client-secret"]["value"] == "p q r s t u v w"
    assert guesses.secrets(df.limit(0)).count() == 0
    again = {r["name"]: r["n"] for r in guesses.secrets(df.unionByName(df)).where("doc_id = 1").collect()}
    assert again == {"password": 4, "api_key": 2}  # repeated rows add up
    long_value = "a b " * 5000
    got = guesses.secrets(spark.createDataFrame([(1, f'token = "{long_value}"')], "doc_id long, text string")).collect()
    assert [r["value"] for r in got] == [long_value]


@pytest.mark.parametrize(
    ("text", "name", "value"),
    [
        ('password          =        "x9Kq"', "password", "x9Kq"),
        ("dbPassword=x9Kq", "dbpassword", "x9Kq"),
        ("accessToken: x9Kq", "accesstoken", "x9Kq"),
        ("mypassword=x9Kq", "mypassword", "x9Kq"),
        ("PGPASSWORD=x9Kq", "pgpassword", "x9Kq"),
        ("tokens: x9Kq", "tokens", "x9Kq"),
        ("password2=x9Kq", "password2", "x9Kq"),
        ("passwordOld=x9Kq", "passwordold", "x9Kq"),
        (r'{\"password\": \"x 9\", \"b\": \"c\"}', "password", "x 9"),
        ("Authorization: Bearer x9Kq.zz", "bearer", "x9Kq.zz"),
        ("""curl -H 'Authorization: Bearer x9Kq'""", "bearer", "x9Kq"),
        ("token: Bearer x9Kq", "token", "x9Kq"),
        ("password: it's8!kQ", "password", "it's8!kQ"),
        ("password = a,b;c9K", "password", "a,b;c9K"),
        ("password: k9$Vw2#p!!)", "password", "k9$Vw2#p!!)"),
        ("run --password=x9Kq", "password", "x9Kq"),
    ],
)
def test_context(spark, text, name, value):
    got = guesses.credentials(spark.createDataFrame([(1, "see " + text + " end")], "doc_id long, text string")).collect()
    assert [(r["name"], r["value"]) for r in got] == [(name, value)]


def test_no_context(spark):
    rows = [(1, "tokenizer: x"), (2, "secretary = y"), (3, "the bearer of the letter: z"), (4, "token" * 20000 + "izer: x")]
    assert guesses.credentials(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
