"""The n-gram join against all pairs, with copies, chains, large buckets and odd rows."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from scanframe.llm import ngram_join


def table(spark, rows):
    return spark.createDataFrame([(i, t, "c", "k", 1) for i, t in rows], "doc_id long, text string, cls string, key string, n int")


def variants(seed, n, words=60, edits=1):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows):
    got = ngram_join.ngram_join(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.copy_of, r.class_id, r.n_links, r.n_class_links) for r in got) == Counter(ngram_join.brute_force(rows))


def test_banding():
    for s in (0.5, 0.8, 0.9):
        b, r = ngram_join.banding(s, 0.999)
        assert 1 - (1 - s**r) ** b >= 0.999 and b * r <= 100 or r == 1


def test_against_all_pairs(spark):
    texts = variants(1, 25) + variants(2, 25, 200, 5) + variants(3, 10, 12) + ["same text here and there now"] * 5 + ["a b", "A  b", "a b c"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (4, " \n"), (None, texts[0]), (5, "x " * 5000)]
    check(spark, rows)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "_DENSE", 4)
    rows = [(i, t) for i, t in enumerate(variants(4, 70, 100, 3) + variants(5, 30, 100, 1))]
    check(spark, rows)


def test_empty_and_repeated_rows(spark):
    assert ngram_join.ngram_join(table(spark, [])).count() == 0
    got = ngram_join.ngram_join(table(spark, [(1, "a b c d e f")] * 3)).collect()
    assert [(r.class_id, r.n_links, r.n_class_links) for r in got] == [(1, 2, 0)] * 3


def test_recall_on_a_whole_table(spark):
    """All pairs of sf0.01 that share a shingle, counted through an inverted list: every link of 0.8 or more is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in rows}
    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    common = Counter((a, b) for ids in having.values() for a, b in combinations(sorted(ids), 2))
    links = Counter(i for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9 for i in (a, b))
    found = {r.doc_id: r.n_links for r in ngram_join.ngram_join(docs).collect()}
    assert sum(links.values()) > 50 and sum(found.values()) >= 0.999 * sum(links.values())
    assert all(found[i] <= links[i] for i in found)
