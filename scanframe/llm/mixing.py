"""Mixing sources to target weights by Pfair scheduling (no Python on executors).

Documents of a source form blocks. Time is cut into slots of one block; a source of weight w gives its i-th block
(from 0) the release time floor(i / w) and the deadline ceil((i + 1) / w), and every slot takes the released block of
the earliest deadline. Weights are exact fractions, so at any time before the first source runs out, a source is less
than one block away from its share, however long the input. The driver computes the schedule in one pass over the blocks,
whose number is bounded, and sends it out as a table of ten bytes a block.

Documents of a source are ordered by a hash, in hash-range buckets that are counted first, so that a source
with a third of all rows is ranked in many tasks. Sources with a share under one of ``units`` share one pool, which is
scheduled by the sum of their weights. In it the i-th document of a source has the place of (i + 1/2) / w, so a source is at most
1/2 + S * w / (2 * pool's weight) documents away from its share of the pool's, with S sources in it.

Defined results: every document comes out once; null sources form a source of their own; null texts are
documents like any other; equal rows get places one after another; an empty table gives an empty result;
once a source has run out in_target is false, and what is left follows by deadline without empty slots; sources
without weight come after all others, in proportion to their rows.

The schedule is bounded: a block holds ``block`` documents, or as many as it takes for the input to have at most
``max_blocks`` blocks (a deviation of one block then stays under a millionth of the input).
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.llm.common import bucket_count

POOL = "\0pool"
REST = "\0rest"
NULL = "\0null"


def _sources(d: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """s, n and the raw weight of each source: as given, else n to a power below one."""
    s = d.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        return s.withColumn("w", F.pow("n", F.lit(power)))
    w = d.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
    return s.join(F.broadcast(w), "s", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def _keyed(sources: DataFrame, units: int) -> DataFrame:
    """Adds k: the source itself, the pool, or the rest (without weight); v: weight inside a shared k."""
    total = sources.agg(F.sum(F.greatest("w", F.lit(0.0)))).first()[0] or 1.0
    k = F.when(F.col("w") / total * units >= 1 - 1e-9, F.col("s")).when(F.col("w") > 0, POOL).otherwise(REST)
    return sources.withColumn("k", k).withColumn("v", F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("n")))


def quotas(sources: DataFrame, units: int) -> DataFrame:
    """k (scheduled source, pool or rest), q: its target weight, n: its documents; at most units + 2 rows."""
    q = F.sum(F.when(F.col("k") != REST, F.col("w")).otherwise(0.0))
    return _keyed(sources, units).groupBy("k").agg(q.alias("q"), F.sum("n").alias("n"))


def schedule(weights: list[float], sizes: list[int], block: int) -> tuple[np.ndarray, int]:
    """The source of each slot until all blocks are placed, and the slot in which a source first lacks a full block."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*[w.denominator for w in exact])
    share = [int(w * unit) for w in exact]
    total = sum(share)
    full, blocks = [n // block for n in sizes], [-(-n // block) for n in sizes]
    at, horizon, picks = [0] * len(share), None if total else 0, array("h")
    ready: list[tuple[int, int, int]] = []
    waiting = [(0, i) for i, w in enumerate(share) if w]
    while ready or waiting:
        while waiting and (waiting[0][0] <= len(picks) or not ready):
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(at[i] + 1) * total // share[i]), -share[i], i))
        i = heapq.heappop(ready)[2]
        if horizon is None and at[i] == full[i]:
            horizon = len(picks)
        if at[i] < blocks[i]:
            picks.append(i)
            at[i] += 1
        if at[i] < blocks[i] or horizon is None:
            heapq.heappush(waiting, (at[i] * total // share[i], i))
    for i, w in enumerate(share):
        picks.extend([i] * (0 if w else blocks[i]))
    return np.frombuffer(picks, np.int16), horizon or 0


def _slots(spark: SparkSession, picks: np.ndarray) -> DataFrame:
    """k_no, block_no, slot: one row per block."""
    slot = np.argsort(picks, kind="stable")
    of = picks[slot]
    no = np.arange(len(of)) - np.searchsorted(of, of)
    return spark.createDataFrame(pa.table({"k_no": of, "block_no": no.astype(np.int64), "slot": slot.astype(np.int64)}))


def _counted(d: DataFrame, *by: str) -> DataFrame:
    """by, bucket, c and before: the rows of each bucket and those of the buckets before it."""
    counts = d.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("before", F.sum("c").over(W.partitionBy(*by).orderBy("bucket")) - F.col("c"))


def _with_slots(buckets: DataFrame, slots: DataFrame, block: int, by: str) -> DataFrame:
    """Adds the slots of the blocks that a bucket reaches into; a bucket has a bounded number."""
    reach = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("c") - 1) / block))
    each = buckets.select(by, "bucket", "k_no", F.explode(reach).alias("block_no")).join(slots, ["k_no", "block_no"])
    return buckets.join(each.groupBy(by, "bucket").agg(F.array_sort(F.collect_list(F.struct("block_no", "slot"))).alias("slots")), [by, "bucket"])


def _placed(d: DataFrame, block: int) -> DataFrame:
    at = F.floor(F.col("nth") / block)
    slot = F.get(F.col("slots"), (at - F.col("slots")[0]["block_no"]).cast("int"))["slot"]
    return d.select("row", "k", at.alias("block_no"), slot.alias("slot"), F.pmod("nth", F.lit(block)).alias("place"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16, units: int = 1000, power: float = 0.5, per_bucket: int = 2000, max_blocks: int = 1 << 20) -> DataFrame:
    """row (the document), block_no, slot, place (in the block), in_target. Ordered by (slot, place) it is the mix."""
    spark = docs.sparkSession
    d = docs.select(F.struct("*").alias("row"))
    d = d.select("row", F.coalesce(F.col("row.source").cast("string"), F.lit(NULL)).alias("s"), F.md5(F.concat_ws("\0", F.coalesce(F.col("row.doc_id").cast("string"), F.lit(NULL)), F.col("row.text")).cast("binary")).alias("h"))
    sources = _sources(d, weights, power)
    # The sum of the pool's weights is rounded, as it depends on the order of adding.
    ks = sorted((r["k"], float(f"{r['q']:.12g}") if r["k"] == POOL else r["q"], r["n"]) for r in quotas(sources, units).collect())
    block = max(block, -(-sum(n for *_, n in ks) // max_blocks))
    picks, horizon = schedule([q for _, q, _ in ks], [n for *_, n in ks], block)
    slots = _slots(spark, picks)
    keys = F.broadcast(spark.createDataFrame(pa.table({"k": pa.array([k for k, *_ in ks], pa.string()), "k_no": np.arange(len(ks), dtype=np.int16)})))  # at most units + 2 rows
    n = bucket_count(docs.select("source"), per_bucket)
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 * n).cast("long"))
    buckets = _counted(d, "s").join(_keyed(sources, units).select("s", "k", "v"), "s").join(keys, "k")
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("s", "bucket").orderBy("h")) - 1)
    nth = F.col("before") + F.col("rank")
    own = _with_slots(buckets.where(~F.col("k").isin(POOL, REST)), slots, block, "s")
    out = _placed(ranked.join(own, ["s", "bucket"]).withColumn("nth", nth), block)
    if any(k in (POOL, REST) for k, *_ in ks):
        sums = _keyed(sources, units).groupBy("k").agg(F.sum("v").alias("k_v"))
        shared = buckets.where(F.col("k").isin(POOL, REST)).join(F.broadcast(sums), "k")
        p = ranked.join(shared, ["s", "bucket"]).withColumn("due", (nth + 0.5) / F.col("v"))
        # At any time the documents due in a span are at most in proportion to it, so no bucket is large.
        p = p.select("row", "k", "k_no", "due", "h", F.floor(F.col("due") * F.col("k_v") / per_bucket).alias("bucket"))
        own = _with_slots(_counted(p, "k", "k_no"), slots, block, "k").drop("k_no")
        p = p.withColumn("rank", F.row_number().over(W.partitionBy("k", "bucket").orderBy("due", "h")) - 1)
        out = out.unionByName(_placed(p.join(own, ["k", "bucket"]).withColumn("nth", nth), block))
    return out.withColumn("in_target", F.col("slot") < F.lit(horizon))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("row.doc_id", "row.source", "block_no", "slot", "place", "in_target")
