"""Quality rules, line dedup and mixing against plain Python on small tables, with nulls, ties and clashing names."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanframe.llm import common, line_dedup, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, h string, key string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, "r", "w", "h", "k") for i, t, l, s in rows], SCHEMA)


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    hit = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    (1, "one two three four five six seven eight nine ten", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, "  \n\t ", "en", "a"),
    (5, "a b c d e a b c d e x\na b c d e\nx\nx\n", "en", "a"), (None, "été # % ü\x0bword<>|", "fr", "b"), (6, "z " * 3000, "en", "a"), (6, "z " * 3000, "en", "a"),
]


def test_quality_counts(spark):
    got = quality.quality_rules(table(spark, TEXTS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *counts(t)) for i, t, _, _ in TEXTS), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)


def test_quality_adapts(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(40)), "en", "a") for i in range(200)]
    junk = [(900 + i, " ".join("#" * 9 + f"w{i + k}" for k in range(40)), "en", "a") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(table(spark, clean + junk)).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)
    marked = [(i, t.replace("word", "#" * 9), l, "b") for i, t, l, _ in clean]  # here the same ratio is the rule
    assert all(r.kept for r in quality.quality_rules(table(spark, marked)).collect())
    assert quality.quality_rules(table(spark, [])).count() == 0


def test_quality_rules_all_bind(spark):
    plain = lambda i, n=40: [f"word{(i * 7 + k * k) % 97}" for k in range(n)]
    lines = lambda w: "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))
    clean = [(i, lines(plain(i)), "en", "a") for i in range(300)]
    odd = {
        "symbol_ratio": lines(["#" + x for x in plain(1)]),
        "dup_line_ratio": "\n".join(x + "\nx y" * (k % 2) for k, x in enumerate(lines(plain(2)).split("\n"))),
        "repeat_ratio": lines([*plain(3, 80), *plain(3, 6)]),
        "high mean_word": lines([x + "long" for x in plain(4)]),
        "low mean_word": lines([x[-3:] for x in plain(5)]),
    }
    rows = clean + [(1000 + i, t, "en", "a") for i, t in enumerate(odd.values())] + [(2000 + i, "z " * 50, "en", "a") for i in range(60)]
    m = common.materialize(quality.quality_metrics(table(spark, rows)), "metrics")
    fences = quality.thresholds(m).first()
    got = {r.doc_id: r for r in quality.judge(m, quality.thresholds(m)).collect()}
    assert all(got[i].kept for i, *_ in clean)
    for i, name in enumerate(odd):
        r, c = got[1000 + i], name.split()[-1]
        outside = [x for x in quality.RATIOS if r[x] > fences[f"high_{x}"] or (x == "mean_word" and r[x] < fences["low_mean_word"])]
        assert not r.base_failed and not r.kept and outside == [c], (name, outside)


def test_quality_sketch_against_exact_quantiles(spark):
    r = random.Random(5)
    groups = {("en", "a"): 700, ("en", "b"): 150, ("fr", "a"): 40, (None, None): 130}
    m = [(l, s, r.choice([0.0, r.random() ** 3]), r.random(), r.lognormvariate(1, 2), 4 + r.random()) for (l, s), n in groups.items() for _ in range(n)]
    names = list(quality.RATIOS)
    d = spark.createDataFrame(m, "lang string, source string, " + ", ".join(f"{c} double" for c in names))
    at = (0.10, 0.25, 0.50, 0.75, 0.90)
    for part in (1, 3):
        got = quality.quantiles(quality.sketches(d.repartition(part)), at, "lang", "source").collect()
        assert len(got) == 4 * len(groups)
        for x in got:
            v = sorted(y[2 + names.index(x.ratio)] for y in m if y[:2] == (x.lang, x.source))
            assert x.n == len(v)
            for k, q in enumerate(at):
                exact = v[math.floor((len(v) - 1) * q)]
                assert abs(x[f"q{k}"] - exact) <= quality.ACCURACY * exact + 1e-12
    merged = quality.quantiles(quality._merged(quality.sketches(d), "lang"), at, "lang").collect()
    assert {(x.lang, x.n) for x in merged} == {("en", 850), ("fr", 40), (None, 130)}


def test_quality_groups(spark):
    """Own fences from 100 documents on, the language's below, everyone's below that; verdicts by plain comparison."""
    base = lambda i, mark="": " ".join(f"{mark}word{(i * 7 + k * k) % 97}" for k in range(40))
    rows = [(i, base(i), "en", "a") for i in range(150)] + [(1000 + i, base(i, "##"), "en", "b") for i in range(150)] + [(2000 + i, base(i), "en", "c") for i in range(20)] + [(3000 + i, base(i, "#####"), "xx", None) for i in range(5)]
    m = common.materialize(quality.quality_metrics(table(spark, rows)), "metrics")
    f = {(x.lang, x.source): x for x in quality.thresholds(m).collect()}
    assert f["en", "a"].high_symbol_ratio < f["en", "b"].high_symbol_ratio and f["en", "a"].n == 150
    assert f["en", "c"].high_symbol_ratio not in (f["en", "a"].high_symbol_ratio, f["xx", None].high_symbol_ratio) or f["en", "c"].high_symbol_ratio >= f["en", "b"].high_symbol_ratio
    for x in quality.judge(m, quality.thresholds(m)).collect():
        g = f[x.lang, x.source]
        inside = x.mean_word >= g.low_mean_word and all(x[c] <= g[f"high_{c}"] for c in quality.RATIOS)
        assert x.kept == (not x.base_failed and inside)


def dedup(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        full = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a in range(len(full) - 2):
            w = tuple(x for _, x in full[a : a + 3])
            if w in seen:
                gone |= {k for k, _ in full[a : a + 3]}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark):
    rows = [(3, "p\nq\nr\ns\nown"), (1, "a\n\n b \nc\nd"), (2, "x\na\nb\nc\nd\ny"), (4, "a\nb"), (5, None), (6, ""), (None, "q\nr\ns"), (7, "l\nm\nn\nl\nm\nn\nl\nm\nn")]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    got = {r.row.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got == dedup(rows)
    twice = table(spark, [(1, "a\nb\nc", "en", "a")] * 2)
    assert [r.text for r in line_dedup.line_dedup(twice).collect()] == ["a\nb\nc"] * 2
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_dedup_of_many_lines(spark):
    rows = [(1, "\n".join(f"a{k % 50000}" for k in range(100_000))), (2, "\n".join(f"a{k}" for k in range(30_000))), (3, "\n".join(["same"] * 20_000))]
    out = line_dedup.line_dedup(table(spark, [(i, t, "en", "a") for i, t in rows]))
    got = {r.row.doc_id: r.text for r in out.where("n_removed >= 0 and length(text) > 0").collect()}  # a filter, as the pipeline has
    assert got == {i: t for i, t in dedup(rows).items() if t}


def test_hot_windows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(i, f"own {i}\nL1\nL2\nL3\nL4\nend {i}") for i in range(300)] + [(1000 + i, "p\nq\nr") for i in range(3)]
    got = {r.row.doc_id: r.text for r in line_dedup.line_dedup(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == dedup(rows)


def test_join_salted_equals_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 3), (None, 4), ("c", 30)) for i in range(n)], "g string, i int")
    one = spark.createDataFrame([("a", 50, 1), ("c", 30, 2), ("z", 1, 3)], "g string, n long, v int")
    for how in ("inner", "left"):
        assert sorted(map(str, common.join_salted(rows, one, "g", F.col("i"), how).select("g", "i", "v").collect())) == sorted(map(str, rows.join(one, "g", how).select("g", "i", "v").collect()))


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 7}, None])
def test_mix_stays_within_a_block(spark, weights):
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate("a" * 600 + "b" * 320 + "c" * 100)] + [(5000, None, None, None)]
    out = mixing.mix(table(spark, rows), weights, block=4, units=50, per_bucket=64)
    got = out.select("row.doc_id", "k", "slot", "place", "in_target").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    q = {r.k: r.q for r in mixing.quotas(mixing._sources(table(spark, rows).selectExpr("coalesce(source, '\\0null') s"), weights, 0.5), 50).collect()}
    slots = {r.slot: r.k for r in got if r.in_target}
    assert sorted(slots) == list(range(len(slots)))
    total, done = sum(q.values()), Counter()
    for t in range(len(slots)):
        done[slots[t]] += 1
        for k, n in q.items():
            assert abs(done[k] - (t + 1) * n / total) < 1
    assert mixing.mix(table(spark, [])).count() == 0


@pytest.mark.parametrize("n, weights", [({"a": 16000, "b": 16000, "c": 16000}, None), ({"a": 6000, "b": 5000, "c": 4000, "d": 300}, {"a": 0.7, "b": 0.53, "c": 0.31, "d": 0.002})])
def test_mix_follows_raw_weights_over_a_long_input(spark, n, weights):
    rows = [(i, None, "en", s) for i, s in enumerate(x for s, k in n.items() for x in s * k)]
    got = mixing.mix(table(spark, rows), weights, block=2).where("in_target").select("k", "slot").distinct().collect()
    w = weights or {s: k**0.5 for s, k in n.items()}
    total, done = sum(w.values()), Counter()
    assert len(got) > 3000
    for t, r in enumerate(sorted(got, key=lambda r: r.slot)):
        done[r.k] += 1
        assert r.slot == t and all(abs(done[k] - (t + 1) * x / total) < 1 + 1e-9 for k, x in w.items())


def test_mix_pool_follows_its_own_weights(spark):
    n = {"a": 900, "b": 300, "c": 300, "d": 20, "e": 9}
    w = {"a": 1.0, "b": 0.01, "c": 0.002, "d": 0.004}  # b, c and d share the pool; e has no weight
    rows = [(i, None, "en", s) for i, s in enumerate(x for s, k in n.items() for x in s * k)]
    got = mixing.mix(table(spark, rows), w, block=4, units=50, per_bucket=64).select("row.doc_id", "row.source", "k", "slot", "place").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows) and len({(r.slot, r.place) for r in got}) == len(got)
    pool = [r.source for r in sorted(got, key=lambda r: (r.slot, r.place)) if r.k == mixing.POOL]
    total, done = w["b"] + w["c"] + w["d"], Counter()
    assert set(pool) == {"b", "c", "d"}
    for t, s in enumerate(pool[:79]):  # until d has run out
        done[s] += 1
        assert all(abs(done[k] - (t + 1) * w[k] / total) <= 0.5 + 1.5 * w[k] / total for k in "bcd")
    last = max(r.slot for r in got if r.source != "e")
    assert all(r.slot > last for r in got if r.source == "e")


def test_mix_bounds_its_schedule(spark):
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate("a" * 600 + "b" * 320 + "c" * 100)]
    got = mixing.mix(table(spark, rows), block=4, max_blocks=30).select("row.doc_id", "slot", "place").collect()
    assert sorted(r.doc_id for r in got) == list(range(1020)) and len({(r.slot, r.place) for r in got}) == 1020
    assert max(r.slot for r in got) < 33


def test_mix_keeps_repeated_rows(spark):
    rows = [(1, "same", "en", "a")] * 50 + [(2, None, "en", None)] * 3
    got = mixing.mix(table(spark, rows), block=4).select("row.doc_id", "slot", "place").collect()
    assert Counter(r.doc_id for r in got) == {1: 50, 2: 3} and len({(r.slot, r.place) for r in got}) == 53


def edf(weights, sizes, block):
    """Slot by slot: of the blocks released by now, the one with the earliest deadline; empty slots are closed up."""
    w = [Fraction(x) / sum(map(Fraction, weights)) for x in weights]
    blocks, done, out, t = [-(-n // block) for n in sizes], [0] * len(w), [], 0
    while any(d < b for d, b, x in zip(done, blocks, w, strict=True) if x):
        ready = [(math.ceil((done[i] + 1) / x), -x, i) for i, x in enumerate(w) if x and done[i] < blocks[i] and math.floor(done[i] / x) <= t]
        if not ready:  # the earliest release comes next
            i = min((math.floor(done[i] / x), i) for i, x in enumerate(w) if x and done[i] < blocks[i])[1]
            ready = [(0, 0, i)]
        i = min(ready)[2]
        out.append(i)
        done[i] += 1
        t += 1
    return out + [i for i, x in enumerate(w) if not x for _ in range(blocks[i])]


def test_schedule_against_slot_by_slot():
    r = random.Random(7)
    for _ in range(60):
        n = r.randrange(1, 7)
        weights = [r.choice([1, 2, 3, 0.5, 0.3, 7, r.random()]) for _ in range(n)]
        sizes = [r.randrange(1, 90) for _ in range(n)]
        picks, horizon = mixing.schedule([float(x) for x in weights], sizes, 3)
        want = edf([float(x) for x in weights], sizes, 3)
        assert sorted(picks.tolist()) == sorted(want) and 0 <= horizon <= len(want)
        assert picks.tolist()[:horizon] == want[:horizon]
        done, total = [0] * n, sum(map(Fraction, map(float, weights)))
        for t, i in enumerate(picks.tolist()[:horizon]):
            done[i] += 1
            assert all(abs(d - (t + 1) * Fraction(float(x)) / total) < 1 for d, x in zip(done, weights, strict=True))


def test_schedule_over_a_million_slots():
    weights = [0.1, 0.37, 0.0123, 1 / 3, 0.000517]
    total = sum(map(Fraction, weights))
    picks, horizon = mixing.schedule(weights, [int(x / float(total) * 1_000_000) + 5 for x in weights], 1)
    assert horizon > 990_000
    for i, x in enumerate(weights):
        share = float(Fraction(x) / total)
        off = np.cumsum(picks[:horizon] == i) - share * np.arange(1, horizon + 1)
        assert np.abs(off).max() < 1 + 1e-6
