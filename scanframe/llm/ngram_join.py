"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every text is reduced to the set of its five-word shingles (64-bit hashes). Texts with equal sets form a class;
   from here on a class is one row, however many copies it has.
2. MinHash signatures are cut into bands whose count and rows follow from the target recall at the threshold.
   Classes that share a band hash meet in a bucket. Buckets with the same members are merged.
3. Buckets are cut into blocks, and pairs of blocks are verified on full shingle sets in separate tasks. Small
   buckets share tasks. A task returns each member's number of links and one parent (a spanning forest of the
   links), so a bucket of m members gives at most m rows per block, never its pairs.
4. A pair that meets in several buckets is counted in the least of them. Groups are the connected components
   of the links, found by alternating large and small stars on tables.

A-Z are lowered and words are runs of characters that are not white space; a text of one to four words is one shingle.

Defined results: null and empty texts and texts without words have no shingles and no links, each is its own group;
rows equal in doc_id and text are copies like others (each counts); null ids come last where the first of a group is
chosen; other columns are not read. Recall of links at the threshold is as given (0.999), higher above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import materialize, row_key

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Members of a block; a task compares two blocks at most.
BLOCK = 256
#: Bytes of shingles that small buckets share a task up to.
PACK_BYTES = 4 << 20
_DENSE = 24


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have with so many hashes, with enough bands for the recall."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = bands, rows
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text. known: hashes of words met before."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(s)


class MinHash:
    """Least values of so many multiply-add permutations of the upper 32 bits of shingle hashes."""

    def __init__(self, n: int, width: int = 1024) -> None:
        r = np.random.default_rng(20240229)
        self.a, self.b = (r.integers(0, 1 << 32, (n, 1), dtype=np.uint32) for _ in range(2))
        self.a |= np.uint32(1)
        self.room = np.empty((n, width), np.uint32)  # stays in the cache

    def __call__(self, s: np.ndarray) -> np.ndarray:
        s, width = (s >> np.uint64(32)).astype(np.uint32), self.room.shape[1]
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(s), width):
            part = s[k : k + width]
            v = self.room[:, : len(part)]
            np.multiply(self.a, part, out=v)
            np.add(v, self.b, out=v)
            np.minimum(out, v.min(axis=1), out=out)
        return out


def _trim(known: dict[bytes, int]) -> None:
    if len(known) > 300_000:
        known.clear()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key, cls (digest of the shingle set, null without shingles), n (its size), bands (their hashes)."""
    names = ["doc_id", "key", "cls", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        minhash = MinHash(bands * rows)
        for b in batches:
            cls, n, band = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), known)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                m = minhash(s).reshape(bands, rows) if len(s) else None
                band.append(None if m is None else np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(m)], np.uint64).view(np.int64))
                _trim(known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int32()), pa.array(band, pa.list_(pa.int64()))], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return source.mapInArrow(run, "doc_id bigint, key bigint, cls binary, n int, bands array<bigint>")


def _first() -> Column:
    """The order in which the first row of a class or group is chosen."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, m, cls: members of the buckets of two or more; of those with the same members, one."""
    each = classes.select("cls", F.explode("bands").alias("bucket"))
    token = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"x{k}") for k in range(2)]
    own = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), *token).where("m > 1")
    one = own.groupBy("m", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    return each.join(one, "bucket")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, set: shingle sets of the classes in wanted (cls, doc_id, key), from the texts of their first rows."""
    source = docs.select(F.col("doc_id").cast("string").alias("id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    w = wanted.select(F.col("doc_id").cast("string").alias("w_id"), F.col("key").alias("w_key"), "cls")
    found = source.join(w, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            sets = []
            for t in b.column(1):
                sets.append(shingles(t.as_py(), known).tobytes())
                _trim(known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["cls", "set"])

    return found.mapInArrow(run, "cls binary, set binary").dropDuplicates(["cls"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, through a dense product over the shingles that two or more have."""
    ids, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = n[at] > 1
    new = np.cumsum(n > 1) - 1
    row, col = row[shared], new[at[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else 0) + width + 1, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], col[a:b] - k * width] = 1
        out += m @ m.T
    return out


def _linked(sets: list[np.ndarray], side: np.ndarray, both: bool, threshold: float) -> np.ndarray:
    """Pairs (i < j) of at least the threshold; with both, only those of different sides."""
    n = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    near = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
    if both:
        near &= side[i] != side[j]
    i, j = i[near], j[near]
    if len(sets) > _DENSE:
        inter = _common(sets)[i, j]
    else:
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    ok = inter >= threshold * (n[i] + n[j] - inter) - 1e-9
    return np.stack([i[ok], j[ok]], axis=1)


def _verify(threshold: float):
    def bucket(f: pd.DataFrame, b: int) -> Iterator[tuple]:
        sets = [np.frombuffer(x, np.uint64) for x in f["set"]]
        pairs = _linked(sets, f["side"].to_numpy(), bool((f["a"] != f["b"]).iloc[0]), threshold)
        if not len(pairs):
            return
        width = max(map(len, f["buckets"]))
        lists = np.full((len(f), width), np.iinfo(np.int64).max)
        for k, x in enumerate(f["buckets"]):
            lists[k, : len(x)] = np.sort(x)
        mine = np.zeros(len(pairs), bool)
        for k in range(0, len(pairs), 65536):
            x, y = lists[pairs[k : k + 65536, 0]], lists[pairs[k : k + 65536, 1]]
            least = np.full(len(x), np.iinfo(np.int64).max)
            for c in range(width):
                met = (x[:, c, None] == y).any(axis=1) & (x[:, c] != np.iinfo(np.int64).max)
                least = np.where(met, np.minimum(least, x[:, c]), least)
            mine[k : k + 65536] = least == b
        pairs = pairs[mine]
        size = f["size"].to_numpy(np.int64)
        links = np.bincount(pairs.ravel(), minlength=len(f))
        docs = np.bincount(pairs[:, 0], size[pairs[:, 1]], len(f)) + np.bincount(pairs[:, 1], size[pairs[:, 0]], len(f))
        cls = f["cls"].tolist()
        root = np.array(sorted(range(len(f)), key=lambda k: cls[k])).argsort()  # rank of each member's digest
        while True:
            low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
            new = root.copy()
            np.minimum.at(new, pairs[:, 0], low)
            np.minimum.at(new, pairs[:, 1], low)
            if (new == root).all():
                break
            root = new
        by_rank = sorted(cls)
        for k in np.flatnonzero(links):
            yield cls[k], int(links[k]), int(docs[k]), by_rank[root[k]]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = [r for b, part in f.groupby("bucket", sort=False) for r in bucket(part.reset_index(drop=True), b)]
        return pd.DataFrame(out, columns=["cls", "links", "docs", "parent"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for all nodes of the edges (u, v)."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, key, copy_of (first document with the same set), class_id and class_key (first
    document of its group), n_links (other documents of at least the threshold, copies too), n_class_links
    (linked texts that differ)."""
    bands, rows = banding(threshold, recall)
    sig = materialize(signatures(docs, bands, rows), "signatures")
    classes = sig.where("cls IS NOT NULL").groupBy("cls").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    members = materialize(_buckets(classes), "buckets")
    lists = members.groupBy("cls").agg(F.collect_list("bucket").alias("buckets"))
    wanted = lists.join(classes.select("cls", "first", "size", "n"), "cls")
    wanted = materialize(wanted.join(_sets(docs, wanted.select("cls", "first.doc_id", "first.key")), "cls"), "sets")
    total = members.join(wanted.select("cls", "n"), "cls").agg(F.sum("n")).first()[0] or 0
    packs = max(1, math.ceil(total * 8 / PACK_BYTES))
    blocks = F.ceil(F.col("m") / BLOCK)
    task = members.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("cls"), "blocks"))
    task = task.select("bucket", "cls", "blocks", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    alone = F.col("blocks") == 1
    task = task.select(
        "bucket", "cls", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("i").alias("side"),
        F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.lit(-1)).alias("pack"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("bucket")).alias("own"),
    )
    full = task.join(wanted.select("cls", "size", "buckets", "set"), "cls")
    found = full.groupBy("pack", "own", "a", "b").applyInPandas(_verify(threshold), "cls binary, links bigint, docs bigint, parent binary")
    found = materialize(found, "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    labels = components(found.select(F.col("cls").alias("u"), F.col("parent").alias("v")))
    named = classes.select("cls", "first", "size").join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left")
    named = named.withColumn("label", F.coalesce("label", "cls"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    named = named.join(heads, "label").select("cls", "first", "size", "head", "links", "docs")
    out = sig.select("doc_id", "key", "cls").join(named, "cls", "left")
    return out.select(
        "doc_id", "key", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("copy_of"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("head.key")).alias("class_key"),
        (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0).cast("long")).alias("n_class_links"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key", "class_key")


def brute_force(rows: list[tuple], threshold: float = THRESHOLD) -> list[tuple]:
    """(doc_id, copy_of, class_id, n_links, n_class_links) by comparing all pairs; rows: (doc_id, text), distinct."""

    def grams(t: str | None) -> frozenset:
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        return frozenset(tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    near = [[j for j, y in enumerate(sets) if j != i and x and y and len(x & y) >= threshold * len(x | y) - 1e-9] for i, x in enumerate(sets)]
    group = list(range(len(rows)))
    for start in range(len(rows)):
        todo = [start]
        while todo:
            i = todo.pop()
            for j in near[i]:
                if group[j] > group[start]:
                    group[j] = group[start]
                    todo.append(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        same = [j for j in range(len(rows)) if j == i or (sets[i] and sets[j] == sets[i])]
        head = min((j for j in range(len(rows)) if group[j] == group[i]), key=order)
        out.append((doc_id, rows[min(same, key=order)][0], rows[head][0], len(near[i]), len({sets[j] for j in near[i]} - {sets[i]})))
    return out


#: All pairs that share a shingle; the ids of the tables are unique. Exact, so it equals the operator where no link is missed.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0) AS x),
d AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS cls, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT cls, min(doc_id) AS first, count(*) AS size, any_value(n) AS n FROM d GROUP BY cls),
r AS (SELECT c.cls, s.g FROM c JOIN s ON s.doc_id = c.first),
p AS (SELECT a.cls AS a, b.cls AS b, count(*) AS both FROM r a JOIN r b ON a.g = b.g AND a.cls <> b.cls GROUP BY a.cls, b.cls),
l AS (SELECT p.a, p.b, y.size FROM p JOIN c x ON x.cls = p.a JOIN c y ON y.cls = p.b WHERE p.both >= 0.8 * (x.n + y.n - p.both) - 1e-9),
t AS (SELECT a AS cls, count(*) AS links, sum(size) AS docs FROM l GROUP BY a),
reach AS (SELECT cls, cls AS other FROM c UNION SELECT reach.cls, l.b FROM reach JOIN l ON l.a = reach.other),
h AS (SELECT reach.cls, min(c.first) AS head FROM reach JOIN c ON c.cls = reach.other GROUP BY reach.cls)
SELECT w.doc_id, coalesce(c.first, w.doc_id) AS copy_of, coalesce(h.head, w.doc_id) AS class_id, (coalesce(c.size, 1) - 1 + coalesce(t.docs, 0))::BIGINT AS n_links, coalesce(t.links, 0)::BIGINT AS n_class_links
FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN c ON c.cls = d.cls LEFT JOIN h ON h.cls = d.cls LEFT JOIN t ON t.cls = d.cls
"""
