"""Each stage of the pipeline against a plain version, on whole small tables."""

from collections import Counter

import pytest

import corpus_pipeline as p
from scanframe.llm import decontam, ngram_join
from tests.llm.test_native_ops import dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "srcX", 0), (9002, "123 !!", "en", None, 6), (9003, "the and of it is was the", "en", None, 24), (9003, "the and of it is was the", "en", None, 24)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs]
    for name, f in p.STAGES:
        out.append(p.materialize(f(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_and_language(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    kept, first = Counter(rows(steps[1])), Counter(rows(steps[0]))
    gone = first - kept
    assert not kept - first and {(None, None), (9001, ""), (9002, "123 !!")} <= set(gone)
    assert sum(gone.values()) <= 0.02 * sum(first.values()) + 3


def test_line_dedup_stage(steps):
    want = dedup([r for r in rows(steps[1]) if r[0] != 9003])
    got = dict(r for r in rows(steps[2]) if r[0] != 9003)
    empty = {i for i, t in want.items() if not t.strip(" \t\n\x0b\x0c\r")}
    assert got == {i: t for i, t in want.items() if i not in empty}
    assert all(r.n_chars == len(r.text) for r in steps[2].collect() if r.doc_id in want and got[r.doc_id] == r.text)


def test_document_dedup_stage(steps):
    before = sorted(set(rows(steps[2])))
    want = {i for i, _, head, *_ in ngram_join.brute_force(before) if i == head}
    assert sorted(i for i, _ in rows(steps[3])) == sorted(want)


def test_decontamination_stage(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in decontam.brute_force(rows(steps[3]), items) if r[5]}
    assert bad and sorted(rows(steps[4])) == sorted(r for r in rows(steps[3]) if r[0] not in bad)


def test_mixing_stage(steps):
    assert Counter(rows(steps[5])) == Counter(rows(steps[4]))
    at = steps[5].select("mix_slot", "mix_place").collect()
    assert len(set(map(tuple, at))) == len(at)


def test_empty_documents(spark, steps):
    docs = steps[0].limit(0)
    for _, f in p.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
