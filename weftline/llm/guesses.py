"""Secret scan: how many guesses a password cracker needs for values in credential context.

A value is what follows a name such as password, token or api_key and a sign of assignment.
Its cost is found by dynamic programming over its characters: the cheapest segmentation
into dictionary words, dates, repeats, keyboard walks and brute-force spans. The guesses
of a segmentation are the product of its spans' guesses, times JOIN for each span but the
first, for where one ends and what comes next. All costs are logarithms to the base of 10,
so that the cheapest way to reach each character is all that has to be known of it, and the
time is nearly linear in the value's length. A value of at least `least` is a secret.

* word: its rank in a list, doubled for capitals or for digits in place of letters. The list
  is what crackers try first, then the whole words of a public tokenizer's vocabulary in
  the order of their ids, which is nearly that of their frequency.
* date: days of 20 years at least, times 4 with separators.
* repeat: the cost of a unit of any length that is no repeat itself, times the copies; three
  characters at least.
* walk: three neighbouring keys or more: the first key, NEIGHBOURS twice for the first step
  and each turn, STRAIGHT for each further step in the same direction.
* brute: ten for each character.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import VOCABULARY, on_worker

NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?key|client[_-]?secret|credentials?|bearer"
# The word that holds a name must end with it, or go on with s, digits, - or _ or a capital.
WORD = rf"(?<![a-z0-9_-])[_-]*+(?=[a-z0-9_-]*?(?:{NAMES})s?[0-9]*(?:[_-]|(?-i:(?<=[a-z0-9])[A-Z])|(?![a-z0-9])))([a-z0-9][a-z0-9_-]*+)"
VALUE = r"""(\\+"[^"\r\n]+?\\+"|\\+'[^'\r\n]+?\\+'|"[^"\r\n]+"|'[^'\r\n]+'|\S+)"""
CONTEXT = rf"""(?i){WORD}(?:\\*["'])?\s*+(?::=|=>|[:=])\s*+(?:bearer\s++)?{VALUE}"""
BEARER = r"""(?i)authorization(?:\\*["'])?\s*+[:=]\s*+(?:\\*["'])?(bearer)\s++([^\s"'\\]+)"""
GATE = r"""(?i)(?:pass|pwd|secret|token|key|cred|bearer)[a-z0-9_-]*+(?:\\*["'])?\s*+[:=]|bearer\s"""
# What crackers try first, in this order.
FIRST = "password admin welcome secret login master test hello monkey dragon letmein qwerty iloveyou sunshine princess football baseball shadow superman trustno access mustang michael jordan hunter ranger buster thomas robert soccer killer george andrew charlie summer winter spring autumn orange banana cheese coffee changeme default guest root user username passphrase mypassword yourpassword server database system public private example sample placeholder dummy token key apikey money love angel flower purple silver golden diamond computer internet security company office project production staging development".split()
LEET = str.maketrans("4@301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
PLACES = {c: (x + (0.0, 0.5, 0.75, 1.25)[y], y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
BRUTE, JOIN = 1.0, math.log10(4)
START, TURN, ON = math.log10(len(PLACES)), math.log10(2 * 4.6), math.log10(1.25)
# Patterns of dates and which group is the year; group 2 is the separator.
DATES = (
    ([re.compile(rf"([0-9]{{4}})([-/._]?)([0-9]{{{x}}})\2([0-9]{{{y}}})") for x in (1, 2) for y in (1, 2)], 1),
    ([re.compile(rf"([0-9]{{{x}}})([-/._]?)([0-9]{{{y}}})\2([0-9]{{{z}}})") for x in (1, 2) for y in (1, 2) for z in (2, 4)], 4),
)
ORDER = ("word", "date", "repeat", "walk", "brute")


@lru_cache(4)
def dictionary(path: str) -> tuple[dict[str, int], set[str]]:
    """(rank of each word, all beginnings of words) of FIRST and the vocabulary file at path."""
    ranks = {w: i + 1 for i, w in enumerate(FIRST)}
    tokens = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens.append((int(rank), base64.b64decode(token)))
    for _, token in sorted(tokens):
        word = token[1:].lower()
        if token[:1] == b" " and len(word) > 1 and word.isalpha():
            ranks.setdefault(word.decode("ascii"), len(ranks) + 1)
    return ranks, {w[:k] for w in ranks for k in range(1, len(w) + 1)}


def word_cost(span: str, rank: int, changed: bool) -> float:
    """log10 of the rank, doubled for each of: a capital first or capitals alone, other capitals, digits for letters."""
    upper = sum(c.isupper() for c in span)
    case = 0 if not upper else 1 if upper == len(span) or (upper == 1 and span[0].isupper()) else min(upper, len(span) - upper) + 1
    return math.log10(rank) + (case + changed) * math.log10(2)


def date_guesses(span: str) -> float | None:
    """The least of all ways to read the span as a date: year of four digits first, or of four
    or two last, day and month of one or two in either order, and one kind of separator or none."""
    readings = []
    for pattern, year in DATES:
        for m in (re.fullmatch(p, span) for p in pattern):
            if m:
                readings.append((m[year], *(m[k] for k in (1, 3, 4) if k != year), m[2]))
    found = []
    for year, a, b, sign in readings:
        y = int(year) + (0 if len(year) == 4 else 1900 if int(year) > 50 else 2000)
        if 1 <= int(a) <= 31 and 1 <= int(b) <= 31 and min(int(a), int(b)) <= 12 and 1000 <= y <= 2100:
            found.append(max(abs(y - 2025), 20) * 365.0 * (4 if sign else 1))
    return min(found, default=None)


def key_step(a: str, b: str) -> tuple[float, int] | None:
    """Direction of the step between two neighbouring keys, None if they aren't."""
    p, q = PLACES.get(a.lower().translate(SHIFTED)), PLACES.get(b.lower().translate(SHIFTED))
    if not p or not q or p == q or abs(p[1] - q[1]) > 1 or abs(p[0] - q[0]) > 1.01:
        return None
    return math.copysign(1, q[0] - p[0]), q[1] - p[1]


def periodic_runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal runs of two or more copies of a unit that is no
    repeat itself. A run with period p holds two places that are multiples of p, so equal
    characters at multiples of p show where to look: n log n places in all."""
    n = len(value)
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    runs: list[tuple[int, int, int]] = []
    by_length: list[tuple[int, int, int]] = []  # longest first
    for p in range(1, n // 2 + 1):
        hits = np.flatnonzero(code[: n - p : p] == code[p::p][: -(-(n - p) // p)]) * p
        for s, e, q in by_length:
            if e - s <= p:
                break
            if p % q == 0:  # within that run the unit is a repeat itself
                hits = hits[(hits < s) | (hits + p >= e)]
        done, new = -1, False
        for t in hits.tolist():
            if t < done:
                continue
            lo = t
            while lo and code[lo - 1] == code[lo - 1 + p]:
                lo -= 1
            hi = t + p
            while hi < n and code[hi] == code[hi - p]:
                hi += 1
            done = hi - p
            if hi - lo >= 2 * p:
                runs.append((lo, hi, p))
                new = True
        if new:
            by_length = sorted(runs, key=lambda r: r[0] - r[1])
    return sorted(runs)


@lru_cache(1 << 14)
def cost(value: str, path: str = VOCABULARY) -> tuple[float, tuple[tuple[str, str], ...]]:
    """(log10 of the guesses, ((kind, span), ...)) of the cheapest segmentation; "" costs 0.
    Of equal costs the kind that comes first in ORDER wins, then the span that starts first."""
    n = len(value)
    if not n:
        return 0.0, ()
    ranks, beginnings = dictionary(path)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best: list[tuple[float, str, int]] = [(math.inf, "", 0)] * (n + 1)  # cost, kind and start of the last span
    best[0] = (0.0, "", 0)
    brute, walk = (math.inf, 0), (math.inf, 0)  # the cheapest way to here within such a span, and where the span starts
    before, way = (math.inf, 0), None  # of a walk of one step only; direction of the last step
    runs, coming, active = periodic_runs(value), 0, []

    def put(j: int, c: float, kind: str, i: int) -> None:
        if c < best[j][0]:
            best[j] = (c, kind, i)

    for i in range(n + 1):
        # What ends here, apart from words and dates, which were put here before.
        while coming < len(runs) and runs[coming][0] <= i:
            active.append((*runs[coming], {}))
            coming += 1
        for s, e, p, starts in active:
            for k, (j, unit) in enumerate(own := starts.get((i - s) % p, [])):
                if i - j >= max(2 * p, 3):
                    if unit is None:
                        # The way to the unit's end is no dearer than by the unit, so its cost may be left for later.
                        if best[j + p][0] + math.log10((i - j) // p) >= best[i][0]:
                            continue
                        unit = cost(value[j : j + p], path)[0] if p < n else math.inf
                        own[k] = (j, unit)
                    put(i, best[j][0] + (JOIN if j else 0.0) + unit + math.log10((i - j) // p), "repeat", j)
        put(i, walk[0], "walk", walk[1])
        put(i, brute[0], "brute", brute[1])
        if i == n:
            break
        active = [r for r in active if r[1] > i]
        here = best[i][0] + (JOIN if i else 0.0)
        for s, e, p, starts in active:
            # After an earlier start with k copies to here, a start here is of no use for m copies
            # or more unless it is cheaper by what m are fewer than k + m.
            least = 3 if p == 1 else 2
            own = starts.setdefault((i - s) % p, [])
            if i + least * p <= e and all(here < best[j][0] + (JOIN if j else 0.0) + math.log10(((i - j) // p + least) / least) for j, _ in own):
                own.append((i, None))
        for j in range(i + 1, n + 1):
            key = low[i:j]
            as_written, changed = key in beginnings, plain[i:j] in beginnings
            if not as_written and not changed:
                break
            rank = ranks.get(key) if as_written else None
            other = ranks.get(plain[i:j]) if rank is None and changed else None
            if rank or other:
                put(j, here + word_cost(value[i:j], rank or other, rank is None), "word", i)
        if "0" <= value[i] <= "9":
            for j in range(i + 4, min(n, i + 10) + 1):
                g = date_guesses(value[i:j])
                if g is not None:
                    put(j, here + math.log10(g), "date", i)
        step = key_step(value[i - 1], value[i]) if i else None
        if step is None:
            walk = before = (math.inf, 0)
        else:
            going = min(walk, before)
            walk = (going[0] + (ON if step == way else TURN), going[1])
            before = (best[i - 1][0] + (JOIN if i > 1 else 0.0) + START + TURN, i - 1)
        way = step
        brute = min((brute[0] + BRUTE, brute[1]), (here + BRUTE, i))
    spans: list[tuple[str, str]] = []
    at = n
    while at:
        _, kind, i = best[at]
        spans.append((kind, value[i:at]))
        at = i
    return best[n][0], tuple(reversed(spans))


def costs(path: str):
    """Batches with the cost and the segments of their value column; equal values come from a cache."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = on_worker(path)
        for batch in batches:
            found = [cost(v, at) for v in batch.column("value").to_pylist()]
            yield batch.append_column("log10_guesses", pa.array([g for g, _ in found], pa.float64())).append_column("segments", pa.array([" ".join(f"{k}:{s}" for k, s in seg) for _, seg in found], pa.string()))

    return rows


def credentials(docs: DataFrame) -> DataFrame:
    """(doc_id, name, value, n) of the values in credential context, n being how often the
    document assigns it. A value in quotes, escaped ones too, reaches to the closing quote,
    any other to white space. What follows Authorization: Bearer is a value, too."""
    text = F.col("text").cast("string")
    hits = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(GATE))
    group = lambda pattern, k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    pairs = [F.arrays_zip(group(p, 1).alias("name"), group(p, 2).alias("raw")) for p in (CONTEXT, BEARER)]
    rows = hits.select("doc_id", F.explode(F.concat(*pairs)).alias("m"))
    raw = F.col("m.raw")
    escaped, quoted = r"""^\\+(["'])(.+?)\\+\1$""", r"""^(["'])(.+)\1$"""
    value = F.when(raw.rlike(escaped), F.regexp_extract(raw, escaped, 2)).when(raw.rlike(quoted), F.regexp_extract(raw, quoted, 2)).otherwise(F.regexp_replace(raw, r"""^\\*["']+""", ""))
    return rows.select("doc_id", F.lower("m.name").alias("name"), value.alias("value")).where("value <> ''").groupBy("doc_id", "name", "value").agg(F.count("*").alias("n"))


def secrets(docs: DataFrame, least: float = 10.0, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, name, value, n, log10_guesses, segments, is_secret) of every value in
    credential context; is_secret says that it takes 10**least guesses or more.

    A null or empty text has no values; a null doc_id stays null; repeated rows add to n;
    other columns are not read; an empty table gives no rows. Very long texts and values are
    read and scored whole. Of segmentations of equal cost one is shown, by the rule of
    `cost`. `path` is a vocabulary file that every worker can read, or the bare name of one
    added with SparkContext.addFile.
    """
    found = credentials(docs)
    kind = found.schema["doc_id"].dataType.simpleString()
    scored = found.mapInArrow(costs(path), f"doc_id {kind}, name string, value string, n long, log10_guesses double, segments string")
    return scored.withColumn("is_secret", F.col("log10_guesses") >= least)
