"""Secret scans: fixed patterns, plus credential values that are costly to guess.

A credential value (what follows a credential word, that of a fixed ``assign`` match too) is cut into words, dates, repeats,
sequences, keyboard walks, repeated blocks and brute-force characters so that the total guess cost (log10 of guesses) is
least. Values at or over a threshold are reported as kind ``guess``, the span being the value's, beside the fixed kinds
``assign``, ``access`` and ``hex``, which always stay.

The parts of a segmentation, for a value of any length:
* word: a word of the vocabulary with two different letters at least, also in capitals or with look-alike digits;
* repeat, sequence, walk: a longest run of three or more equal or consecutive or four or more neighbouring characters,
  or so much of it from its begin or up to its end as a place lets it have where a word, date, block or other run begins or ends;
* block: a block of two characters or more said again, as often as it fits, from the begin or up to the end of the
  longest stretch that repeats it;
* date, year; any single character by brute force.
All are found in time linear in the value's length but for a logarithm (blocks) and the number of words found.

Defined results: a null or empty text has no spans; spans count code points, end exclusive; of values that begin at one
place the longest counts; equal rows get equal spans; whole texts are read, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import batch_rows


KINDS = ("assign", "access", "hex", "guess")
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINT = re.compile(r"passw|passp|passc|secret|token|api|pwd|auth|credential|key|bearer", re.I | re.A)
#: Contexts in which a value is a credential, wider than the fixed kind: other words, other separators, any characters.
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|client|secret)[_\x20-]?key)"""
    r"""["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*(?:"([^"\n]{8,})"|'([^'\n]{8,})'|([^\s"'<>]{8,}))""",
    re.I | re.A,
)
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: Dates and years at every place, with log10 of their number.
_DATES = (
    (re.compile(rf"(?=({_YEAR}([-/._]?){_MONTH}\2{_DAY}))", re.A), math.log10(365 * 120)),
    (re.compile(rf"(?=({_DAY}([-/._]?){_MONTH}\2{_YEAR}))", re.A), math.log10(365 * 120)),
    (re.compile(rf"(?=({_YEAR}))", re.A), math.log10(120)),
)
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
_LEET = str.maketrans("430157$@", "aeoistsa")
_AT = {c: (r, k + r * 0.5) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}


@lru_cache(1)
def word_ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Whole words of a public vocabulary by rank; its size bounds what is broadcast."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w.removesuffix("</w>")) for w, i in vocab.items() if w.endswith("</w>"))
    return {w: r for r, (_, w) in enumerate(((i, w) for i, w in words if len(w) >= 3 and w.isalpha()), 1)}


def _key(c: str) -> str:
    return _SHIFTED.get(c, c.lower())


#: For ASCII: the key's row and place (nan: no key), whether two characters lie on neighbouring keys, and brute-force costs.
_PLACE = np.array([_AT.get(_key(chr(c)), (math.nan, math.nan)) for c in range(128)])
with np.errstate(invalid="ignore"):
    _NEAR = (np.abs(_PLACE[:, None] - _PLACE[None]) <= 1).all(axis=2) & (_PLACE[:, None] != _PLACE[None]).any(axis=2)
_NO_KEY = np.isnan(_PLACE).any(axis=1)
_NEAR[_NO_KEY] = _NEAR[:, _NO_KEY] = False
_DIGIT, _ALPHA, _OTHER = (math.log10(n) for n in (10, 26, 33))
_P = np.uint64(0x9E3779B97F4A7C15)


def _brute(c: str) -> float:
    return _DIGIT if c.isdigit() else _ALPHA if c.isalpha() else _OTHER


class Words:
    """Ranks of the words with two different letters or more, and an automaton that finds all of them in one pass."""

    def __init__(self, ranks: dict[str, int]) -> None:
        self.ranks = {w: r for w, r in ranks.items() if len(w) >= 3 and len(set(w)) > 1}
        self._build()

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for w, r in self.ranks.items():
            self.automaton.add_word(w, (len(w), math.log10(r + 1)))
        if self.ranks:
            self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        return self.ranks

    def __setstate__(self, ranks: dict) -> None:
        self.ranks = ranks
        self._build()

    def find(self, v: str) -> Iterator[tuple[int, int, float]]:
        """(begin, end, cost) of all words: as they are, in capitals, with look-alikes."""
        low = v.lower()
        if len(low) != len(v):
            low = v
        if not self.ranks:
            return
        upper = np.cumsum([0, *(a != b for a, b in zip(v, low, strict=True))]).tolist()
        for last, (n, cost) in self.automaton.iter(low):
            a, z = last + 1 - n, last + 1
            yield a, z, cost + (upper[z] > upper[a]) * math.log10(2)
        leet = low.translate(_LEET)
        if leet != low:
            other = np.cumsum([0, *(a != b for a, b in zip(low, leet, strict=True))]).tolist()
            for last, (n, cost) in self.automaton.iter(leet):
                a, z = last + 1 - n, last + 1
                if other[z] > other[a] and low[a:z] not in self.ranks:
                    yield a, z, cost + math.log10(4)


def _runs(joined: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the longest runs of characters whose neighbours are joined; joined has one place fewer."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
    return [(a, z + 1) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if z + 1 - a >= least]


def _powers(n: int) -> np.ndarray:
    p = np.ones(n + 1, np.uint64)
    p[1:] = np.multiply.accumulate(np.full(n, _P, np.uint64))
    return p


def _prefix_hashes(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    """h[i]: the polynomial hash of the first i places, so that h[j] - h[i] * power[j - i] is that of the places between."""
    inverse = pow(int(_P), -1, 1 << 64)
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(x), inverse, np.uint64)]))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * down[1:], dtype=np.uint64)]) * power


def _common(h: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the places a and b, up to most, by hashes of prefixes h."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = h[a + mid] - h[a] * power[mid] == h[b + mid] - h[b] * power[mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def blocks(code: np.ndarray, same: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(begin, end, least period) of the longest stretches that repeat a block of two or more twice or more.

    Such a stretch holds two neighbouring multiples of its period; from each such pair it is measured both ways by
    common extensions. In a value of n characters there are n * log(n) pairs, less those in stretches of a divisor."""
    n = len(code)
    if n < 4:
        return
    until, unit = np.zeros(n, np.int64), np.ones(n, np.int64)  # the stretch that a place is in, and its period
    for a, z in same:
        until[a:z] = z
    power = _powers(n)
    hashes = [_prefix_hashes(c.astype(np.uint64) + np.uint64(1), power) for c in (code, code[::-1])]
    seen, period = set(), 2
    while period <= n // 2:
        ps, held = [], 0
        while period <= n // 2 and held < 1 << 16:
            ps.append(period)
            held += n // period
            period += 1
        many = (n - 1) // np.array(ps)
        p = np.repeat(np.array(ps), many)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)) * p
        ok = (code[at] == code[at + p]) & ((until[at] <= at + p) | (p % unit[at] != 0))
        p, at = p[ok], at[ok]
        if not len(p):
            continue
        right = _common(hashes[0], power, at, at + p, n - at - p)
        left = _common(hashes[1], power, n - at - p, n - at, at)
        long = left + right >= p
        for a, z, x in zip((at - left)[long].tolist(), (at + p + right)[long].tolist(), p[long].tolist(), strict=True):
            if (a, z) not in seen:
                seen.add((a, z))
                if z - a > until[a] - a:
                    until[a:z], unit[a:z] = z, x
                yield a, z, x


def segments(value: str, words: Words) -> Iterator[tuple[int, int, float]]:
    """(begin, end, cost) of all parts a segmentation may have, single characters apart."""
    n = len(value)
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    total = np.cumsum([0.0, *map(_brute, value)]).tolist()
    step, low = np.diff(code), np.minimum(code, 127)
    near = _NEAR[low[:-1], low[1:]] & (code[:-1] < 128) & (code[1:] < 128)
    same = _runs(step == 0, 3)
    whole = list(words.find(value))
    whole += [(*m.span(1), cost) for pattern, cost in _DATES for m in pattern.finditer(value)]
    for a, z, p in blocks(code, same):
        k = (z - a) // p
        whole += [(a, a + k * p, total[a + p] - total[a] + math.log10(k)), (z - k * p, z, total[z] - total[z - p] + math.log10(k))]
    yield from whole
    turn = [0] * (n + 1)  # turn[i]: changes of direction on the keyboard at the places before i
    if near.any():
        move = np.diff(_PLACE[low], axis=0)
        turn[2:n] = np.cumsum((move[1:] != move[:-1]).any(axis=1)).tolist()
    kinds = (
        (same, 3, lambda a, z: _brute(value[a]) + math.log10(z - a)),
        (_runs(step == 1, 3) + _runs(step == -1, 3), 3, lambda a, z: math.log10(52 * (z - a))),
        (_runs(near, 4), 4, lambda a, z: math.log10(len(_AT) * (z - a)) + (turn[z - 1] - turn[a + 1]) * math.log10(6)),
    )
    cuts = sorted({x for a, z, *_ in whole for x in (a, z)} | {x for runs, *_ in kinds for r in runs for x in r})
    for runs, least, cost in kinds:
        for a, z in runs:
            yield a, z, cost(a, z)
            for c in cuts[bisect_right(cuts, a) : bisect_left(cuts, z)]:
                if c - a >= least:
                    yield a, c, cost(a, c)
                if z - c >= least:
                    yield c, z, cost(c, z)


def guess_cost(value: str, words: Words) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes.

    The saving over brute force at a place never falls, so it is kept as steps at the ends of parts."""
    total = np.cumsum([0.0, *map(_brute, value)]).tolist()
    ends, saved = [0], [0.0]
    for a, z, cost in sorted(segments(value, words), key=lambda x: (x[1], x[0])):
        s = saved[bisect_right(ends, a) - 1] + total[z] - total[a] - cost
        if s > saved[-1]:
            if ends[-1] == z:
                saved[-1] = s
            else:
                ends.append(z)
                saved.append(s)
    return total[-1] - saved[-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _HINT.search(text):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def values(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the credential values of a text; of those with one begin the longest."""
    out: dict[int, int] = {}
    if _HINT.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                out[m.start(2)] = m.end(2)
        for m in _CONTEXT.finditer(text):
            a, z = m.span(m.lastindex)
            out[a] = max(z, out.get(a, 0))
    return sorted(out.items())


def scan(text: str | None, words: Words, least: float = 10.0) -> tuple[list, list]:
    """Fixed spans and added spans (start, end, kind[, cost]) of one whole text."""
    if not text:
        return [], []
    costs = ((a, z, guess_cost(text[a:z], words)) for a, z in values(text))
    by = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base_spans(text), key=by), [(a, z, "guess", c) for a, z, c in costs if c >= least]


def written(spans: list) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


_OUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, max_cost double"


def secret_scan(docs: DataFrame, vocabulary: str = VOCABULARY, least: float = 10.0) -> DataFrame:
    """One row per document with its counts and spans; no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Words(word_ranks(vocabulary)))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in batch_rows(iter([b])):
                fixed, added = scan(t, shared.value, least)
                kinds = [s[2] for s in fixed]
                rows.append((i, *map(kinds.count, KINDS[:3]), hashlib.sha256(written(fixed).encode()).hexdigest(), written(fixed + added), len(added), max((s[3] for s in added), default=None)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
