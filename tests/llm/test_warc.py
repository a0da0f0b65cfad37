"""Archives written and read back, and lookups by url."""

import base64
import hashlib
from collections import Counter

from scanframe.llm import common, warc

ROWS = [
    (1, "http://www.Example.com/a?b=1", "<p>é</p>"), (2, "https://example.com:8080/", "<p>é</p>"), (3, None, None), (4, "not a url\nx: y", ""), (5, "http://b.org", "x" * 200000),
    (6, "http://b.org", "y"), (None, "http://b.org", "y"), (None, "http://c.org", "z"), (None, "http://c.org", "z"), (7, "http://d.org", "w"), (7, "http://d.org", "w"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "p") for i, u, h in rows], "page_id long, url string, html string, key string, payload string")


def expected(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        response = top.get(h or "", i)
        of = None if i == response else response
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if of is None else "revisit", of))
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    parts = warc.write_archives(table(spark, ROWS))
    got = warc.read_archives(parts).collect()
    assert Counter(tuple(r)[0:1] + tuple(r)[2:6] for r in got) == Counter(expected(ROWS))
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"} >= {(2, "<p>é</p>"), (5, "x" * 200000), (4, "")}
    assert Counter(r.url for r in got) == Counter(u for _, u, _ in ROWS)
    found = warc.lookup(parts, spark.createDataFrame([("http://b.org",), ("http://none.org",), ("http://www.example.com/a?b=1",)], "url string")).collect()
    assert Counter((r.page_id, r.url) for r in found) == Counter([(5, "http://b.org"), (6, "http://b.org"), (None, "http://b.org"), (1, "http://www.Example.com/a?b=1")])
    empty = warc.write_archives(table(spark, []))
    assert warc.read_archives(empty).count() == 0 and warc.lookup(empty, table(spark, ROWS)).count() == 0
    assert warc.lookup(parts, table(spark, [])).count() == 0


def test_lookup_finds_every_page(spark, monkeypatch):
    """Keys over several blocks and parts, long keys with a common beginning, hot payloads."""
    for name, v in (("BLOCK_LINES", 3), ("PART_LINES", 7), ("CLIP", 12), ("RANGE_BYTES", 700), ("READ_BYTES", 500)):
        monkeypatch.setattr(warc, name, v)
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    long = "http://a-long-host.example.com/" + "p" * 50
    rows = [(i, u, f"<p>{k}</p>") for i, (u, k) in enumerate([(None, 1)] * 20 + [("http://b.org/x", 2)] * 15 + [(f"{long}{j}", j % 3) for j in range(30)] + [("http://z.org", 5)])]
    parts = warc.write_archives(table(spark, rows))
    assert parts.count() > 5
    got = warc.lookup(parts, table(spark, rows)).collect()
    assert Counter(tuple(r)[0:1] + tuple(r)[2:6] for r in got) == Counter(expected(rows))
    some = spark.createDataFrame([(None,), (long + "7",), ("http://b.org/",)], "url string")
    assert Counter(r.page_id for r in warc.lookup(parts, some).collect()) == Counter([*range(20), 35 + 7])


def test_small_payloads_are_responses(spark):
    rows = [(1, "http://a.b", "xy"), (2, "http://a.b", "xy"), (3, "http://a.b", "xyz"), (4, "http://a.b", "xyz")]
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.write_archives(table(spark, rows), least=3)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = warc.lookup(warc.write_archives(pages), pages).collect()
    assert Counter(tuple(r)[0:1] + tuple(r)[2:6] for r in got) == Counter(expected([(r.page_id, r.url, r.html) for r in pages.collect()]))
