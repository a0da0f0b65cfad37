"""Benchmark decontamination over a distributed positional inverted index.

The index is built once, from the documents alone. It is partitioned by document: a shard holds the words of about a MB of
whole texts, and for each term (a 64-bit hash of the word) the sorted positions of all its occurrences, documents being
kept apart by a gap. Shards are rows of a table in the shared folder; nothing is shuffled by term, so frequent words
cost no skew. The benchmark is the query set and goes to the shards in blocks of bounded size. A window of an item is found
by intersecting its terms' position lists, each shifted back by the term's place in the window, from the rarest term of
the shard on; all windows of a block go through a step of the intersection at once.

A near match is a start s for which every term of the window has an occurrence within ``slop`` words of its place.

Defined results: null and empty texts have no words and no hits; items without words match nothing; an item with a null id
marks words like any other but is neither counted nor listed; item ids that repeat count once; repeated rows all come
out, with equal results; other columns are not read. Words with equal hashes are taken for equal: with v distinct words
in documents and benchmark any two share one with a chance of about v * v / 3.7e19.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import batch_rows, materialize, row_key

WINDOW = 10
SLOP = 2
#: Text and documents of a shard; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 1 << 20, 4096
#: Text of the items that one broadcast block may hold.
BLOCK_BYTES = 4 << 20
#: Text whose words are Python objects at a time, and candidates that are intersected at a time.
_SLICE, _STEP = 1 << 20, 1 << 18

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_INDEX = "first bigint, ids array<bigint>, keys array<bigint>, n_words array<int>, terms binary, ends binary, positions binary"
_FOUND = "row bigint, doc_id bigint, key bigint, n_words bigint, spans array<int>, items array<string>, near array<string>"
#: Small row groups, so that neither the writer nor the reader of a task holds many shards.
_SMALL = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "16"}


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """Words of the contract, some at a time: A-Z lowered, runs of letters, digits and whatever is not ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _SLICE else raw.find(b" ", at + _SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def words(text: str | None) -> list[bytes]:
    return [w for part in word_slices(text) for w in part]


def _hashes(ws) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)).view(np.int64)


class _Shard:
    """Documents gathered for one shard; only distinct words stay as objects."""

    def __init__(self, first: int) -> None:
        self.first, self.ids, self.keys, self.n, self.size, self.place, self.parts = first, [], [], [], 0, {}, []

    def add(self, doc_id: int | None, key: int, text: str | None) -> None:
        n = 0
        for ws in word_slices(text):
            for w in set(ws).difference(self.place):
                self.place[w] = len(self.place)
            self.parts.append(np.fromiter(map(self.place.__getitem__, ws), np.int32, len(ws)))
            n += len(ws)
        self.ids.append(doc_id)
        self.keys.append(key)
        self.n.append(n)
        self.size += len(text or "")

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def row(self, gap: int) -> dict:
        hashes, n = _hashes(self.place), np.array(self.n, np.int64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        term = rank[np.concatenate([np.zeros(0, np.int32), *self.parts])]
        at = (np.arange(len(term)) + np.repeat(np.arange(len(n)) * gap, n)).astype(np.int32)
        ends = np.cumsum(np.bincount(term, minlength=len(order))).astype(np.int32)
        positions = at[np.argsort(term, kind="stable")]
        return {"first": self.first, "ids": self.ids, "keys": self.keys, "n_words": self.n, "terms": hashes[order].tobytes(), "ends": ends.tobytes(), "positions": positions.tobytes()}


def build_index(docs: DataFrame, slop: int = SLOP) -> DataFrame:
    """The positional index of all words of all documents, as a table of shards."""
    schema = pa.schema([
        ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())),
        ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId() << 40)
        flush = lambda: pa.RecordBatch.from_pylist([shard.row(2 * slop + 1)], schema=schema)
        for row in batch_rows(batches):
            shard.add(*row)
            if shard.full():
                yield flush()
                shard = _Shard(shard.first + len(shard.ids))
        if shard.ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text"))
    return materialize(rows.mapInArrow(run, _INDEX), "postings", **_SMALL)


class Windows:
    """The windows of a block of items, as places in one array of terms."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW) -> None:
        each = [(name, ws) for name, text in items if (ws := words(text))]
        self.names = [name for name, _ in each]
        n = np.fromiter((len(ws) for _, ws in each), np.int64, len(each))
        known = list({w for _, ws in each for w in ws})
        hashes = _hashes(known)
        order = np.argsort(hashes)
        place = {known[k]: r for r, k in enumerate(order)}
        self.terms = hashes[order]
        self.flat = np.fromiter((place[w] for _, ws in each for w in ws), np.int32, int(n.sum()))
        many = np.maximum(n - size + 1, 1)
        self.owner = np.repeat(np.arange(len(each)), many)
        self.start = np.arange(len(self.owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(n) - n, many)
        self.size = np.repeat(np.minimum(n, size), many)


class _Postings:
    """One shard, opened."""

    def __init__(self, row: tuple) -> None:
        self.first, self.ids, self.keys, n, terms, ends, positions = row
        self.n_words = np.array(n, np.int64)
        self.terms, self.ends, self.positions = np.frombuffer(terms, np.int64), np.frombuffer(ends, np.int32).astype(np.int64), np.frombuffer(positions, np.int32).astype(np.int64)
        self.begin = np.concatenate([np.zeros(1, np.int64), self.ends])[:-1]
        self.sorted = np.repeat(np.arange(len(self.ends)) << 32, self.ends - self.begin) + self.positions

    def starts(self, gap: int) -> np.ndarray:
        size = self.n_words + gap
        return np.cumsum(size) - size

    def near(self, term: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
        """Which terms occur within slop of the places at."""
        low = (term << 32) + at
        k = np.searchsorted(self.sorted, low - slop)
        return (k < len(self.sorted)) & (self.sorted[np.minimum(k, len(self.sorted) - 1)] <= low + slop)


def intersect(p: _Postings, terms: np.ndarray, order: np.ndarray, w: np.ndarray, s: np.ndarray, slop: int) -> np.ndarray:
    """Which of the starts s of windows w (rows of terms, -1 behind short ones) have all terms in place, the rarest tried first."""
    alive = np.arange(len(w))
    for j in range(order.shape[1]):
        o = order[w[alive], j]
        t = terms[w[alive], o]
        alive = alive[(t < 0) | p.near(np.maximum(t, 0).astype(np.int64), s[alive] + o, slop)]
    return alive


def search(p: _Postings, q: Windows, slop: int = SLOP) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(windows, starts) of the exact matches in a shard and (windows, positions of their rarest terms) of the near ones."""
    none = np.zeros(0, np.int64)
    exact, close = [(none, none)], [(none, none)]
    at = np.minimum(np.searchsorted(p.terms, q.terms), max(0, len(p.terms) - 1))
    here = p.terms[at] == q.terms if len(p.terms) else np.zeros(len(at), bool)
    count = np.where(here, p.ends[at] - p.begin[at], 0) if len(p.terms) else np.zeros(len(at), np.int64)
    gone = np.concatenate([[0], np.cumsum(count[q.flat] == 0)])
    some = np.flatnonzero(gone[q.start + q.size] == gone[q.start])
    if not len(some):
        return exact[0], close[0]
    place = np.arange(WINDOW)
    for part in np.array_split(some, -(-len(some) // 16384)):
        inside = place < q.size[part][:, None]
        flat = q.flat[np.where(inside, q.start[part][:, None] + place, 0)]
        terms = np.where(inside, at[flat], -1)
        many = np.where(inside, count[flat], 1 << 40)
        order = np.argsort(many, axis=1, kind="stable")
        c = many.min(axis=1)
        for lo, hi in _steps(c):
            w = np.repeat(np.arange(lo, hi), c[lo:hi])
            rare = order[w, 0]
            k = np.arange(len(w)) - np.repeat(np.cumsum(c[lo:hi]) - c[lo:hi], c[lo:hi])
            at_rare = p.positions[p.begin[terms[w, rare]] + k]
            s = at_rare - rare
            ok = intersect(p, terms, order, w, s, 2 * slop)  # what exact and near matches both need
            w, s, at_rare = w[ok], s[ok], at_rare[ok]
            same = intersect(p, terms, order, w, s, 0)
            exact.append((part[w[same]], s[same]))
            shift = np.tile(np.arange(-slop, slop + 1), len(w))
            w, s, at_rare = (np.repeat(x, 2 * slop + 1) for x in (w, s, at_rare))
            ok = intersect(p, terms, order, w, s + shift, slop)
            close.append((part[w[ok]], at_rare[ok]))
    joined = lambda xs: tuple(np.concatenate(x) for x in zip(*xs, strict=True))
    return joined(exact), joined(close)


def _steps(c: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of windows with about _STEP candidates each."""
    total = np.cumsum(c)
    cuts = np.unique(np.searchsorted(total, np.arange(_STEP, total[-1] + _STEP, _STEP), "left") + 1)
    lo = 0
    for hi in np.minimum(cuts, len(c)):
        if hi > lo:
            yield lo, int(hi)
            lo = int(hi)
    if lo < len(c):
        yield lo, len(c)


def _report(p: _Postings, q: Windows, slop: int) -> dict:
    """Columns of the documents of a shard."""
    starts = p.starts(2 * slop + 1)
    (w, s), (v, at) = search(p, q, slop)
    doc = lambda x: np.searchsorted(starts, x, "right") - 1
    spans, items, near = ([[] for _ in starts] for _ in range(3))
    if len(w):
        length = int(starts[-1] + p.n_words[-1]) + 2
        hit = np.cumsum(np.bincount(s, minlength=length) - np.bincount(s + q.size[w], minlength=length)) > 0
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))  # spans end within their document, before its gap
        at_doc = doc(edge)
        for d in np.unique(at_doc):
            spans[d] = (edge[at_doc == d] - starts[d]).tolist()
    for lists, d, o in ((items, doc(s), q.owner[w]), (near, doc(at), q.owner[v])):
        for i, k in np.unique(np.stack([d, o], axis=1), axis=0) if len(d) else ():
            if q.names[k] is not None:
                lists[i].append(q.names[k])
    tidy = lambda xs: [sorted(set(x)) for x in xs]
    rows = p.first + np.arange(len(starts))
    return {"row": rows, "doc_id": p.ids, "key": p.keys, "n_words": p.n_words, "spans": spans, "items": tidy(items), "near": tidy(near)}


_TYPES = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())),
])


def _find(index: DataFrame, items: list[tuple], slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(Windows(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batch_rows(batches, 1):
            found = _report(_Postings(row), shared.value, slop)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in _TYPES], schema=_TYPES)

    return index.mapInArrow(run, _FOUND)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of one row in several blocks as one."""
    for b in batches:
        spans = []
        for lists in b.column(4).to_pylist():
            out: list[int] = []
            for a, z in sorted((x[k], x[k + 1]) for x in lists for k in range(0, len(x), 2)):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], z)
                else:
                    out += [a, z]
            spans.append(out)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(spans, pa.list_(pa.int32())), *b.columns[5:]], schema=_TYPES)


def _blocks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(size / BLOCK_BYTES))


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """Per row of docs: n_words, merged hit spans (start, end, start, ...), items with exact and with near windows."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL")
    index, n, found = build_index(docs, slop), _blocks(bench), None
    for b in range(n):
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toLocalIterator()
        part = _find(index, [(r["item"], r["text"]) for r in rows], slop)
        found = part if found is None else found.unionByName(part)
    if n == 1:
        return found.drop("row")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    one = lambda c: F.first(c).alias(c)
    merged = found.groupBy("row").agg(one("doc_id"), one("key"), one("n_words"), F.filter(F.collect_list("spans"), lambda x: F.size(x) > 0).alias("spans"), every("items"), every("near"))
    return merged.mapInArrow(_merge, _FOUND).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    m = matches(docs, benchmark, slop)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")
    return m.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"), "key",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).drop("key")


#: Windows as texts joined to windows of every length that an item asks for; near ones through each window's rarest word. The ids of
#: the tables are unique.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT row_number() OVER () AS win, item, n, w[k:k + n - 1] AS t, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0) AS x),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n) AS x),
occ AS (SELECT dw.doc_id, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM occ) AS x) AS y GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ WHERE item IS NOT NULL) AS x GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
freq AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
it AS (SELECT win, item, n, o, t FROM (SELECT win, item, n, unnest(t) AS t, generate_subscripts(t, 1) AS o FROM iw) AS x),
rare AS (SELECT win, item, n, r.o AS o, r.t AS t FROM (SELECT win, item, n, arg_min({'o': o, 't': t}, c) AS r FROM (SELECT it.*, coalesce(freq.c, 0) AS c FROM it LEFT JOIN freq ON it.t = freq.t) AS x GROUP BY win, item, n HAVING min(c) > 0) AS y),
cand AS (SELECT DISTINCT rare.win, rare.item, rare.n, tok.doc_id, tok.p - rare.o + s.s AS s FROM rare JOIN tok ON rare.t = tok.t, (SELECT unnest(range(-2, 3)) AS s) AS s),
wide AS (SELECT DISTINCT doc_id, t, p + s.s AS p FROM tok, (SELECT unnest(range(-2, 3)) AS s) AS s),
ok AS (SELECT cand.win, cand.item, cand.doc_id, cand.s FROM cand JOIN it ON cand.win = it.win JOIN wide ON wide.doc_id = cand.doc_id AND wide.t = it.t AND wide.p = cand.s + it.o
  GROUP BY cand.win, cand.item, cand.doc_id, cand.s, cand.n HAVING count(*) = cand.n),
nr AS (SELECT doc_id, count(DISTINCT item) AS n FROM ok GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AS contaminated, coalesce(nr.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN nr ON d.doc_id = nr.doc_id
"""


def brute_force(docs: list[tuple], items: list[tuple], slop: int = SLOP) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) by comparing every window."""
    out = []
    for doc_id, text in docs:
        ws, hit, got, near = words(text), set(), set(), set()
        have = set(ws)
        for item, t in items:
            b = words(t)
            for k in range(max(1, len(b) - WINDOW + 1) if b else 0):
                w = b[k : k + WINDOW]
                for s in range(-slop, len(ws) + slop) if have.issuperset(w) else ():
                    if ws[max(s, 0) : s + len(w)] == w and s >= 0:
                        hit.update(range(s, s + len(w)))
                        got.add(item)
                    if all(x in ws[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, x in enumerate(w)):
                        near.add(item)
        got, near = {str(i) for i in got if i is not None}, {str(i) for i in near if i is not None}
        out.append((doc_id, len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit), len(near)))
    return out
