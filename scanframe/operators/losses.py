"""Training losses as forward-only metrics of two columns of a volume, one value per volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.operators import windows as Wn

_AT = ["vol", *Wn.AXES]


def _only(d: DataFrame, value: Column, name: str = "v") -> DataFrame:
    return d.select(*_AT, value.alias(name))


def guidance(d: DataFrame, pred: str, target: str, sigma: float = 2.0, radius: int = 2) -> DataFrame:
    """Mean absolute value of the blurred difference."""
    b = Wn.blur(_only(d, F.col(pred) - F.col(target)), sigma, radius)
    return b.groupBy("vol").agg(F.avg(F.abs("v")).alias("loss"))


def _magnitudes(d: DataFrame) -> DataFrame:
    """a and b: the gradients' magnitudes of p and t, side by side without a join."""
    for c, name in (("p", "a"), ("t", "b")):
        d = Wn.sobel(d, c, f"_{c}")
        d = d.withColumn(name, F.sqrt(sum((F.col(f"_{c}g{x}") ** 2 for x in Wn.AXES), F.lit(0.0)) + 1e-6)).drop(*[f"_{c}g{x}" for x in Wn.AXES])
    return d


def _both(d: DataFrame, pred: str, target: str) -> DataFrame:
    return d.select(*_AT, F.col(pred).alias("p"), F.col(target).alias("t"))


def dice_edge(d: DataFrame, pred: str, target: str, scale: float = 12.0, threshold: float = 0.05, eps: float = 1e-6) -> DataFrame:
    """L1 plus soft Dice loss of sigmoid edge maps."""
    a, b = (1 / (1 + F.exp(-scale * (F.col(c) - threshold))) for c in ("a", "b"))
    return _magnitudes(_both(d, pred, target)).groupBy("vol").agg((F.avg(F.abs(a - b)) + 1 - (2 * F.sum(a * b) + eps) / (F.sum(a) + F.sum(b) + eps)).alias("loss"))


def multi_scale_gradient(d: DataFrame, pred: str, target: str, sigmas: tuple = (1.0, 2.0, 4.0), weights: tuple = (1.0, 1.0, 0.5)) -> DataFrame:
    """Weighted sum over scales of the mean absolute difference of gradient magnitudes of the blurred maps."""
    out = None
    for s, w in zip(sigmas, weights, strict=True):
        smooth = Wn.blur(_both(d, pred, target), s, max(3, int(s * 4) | 1) // 2, value=("p", "t"))
        part = _magnitudes(smooth).groupBy("vol").agg((F.avg(F.abs(F.col("a") - F.col("b"))) * w).alias("loss"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("vol").agg(F.sum("loss").alias("loss"))


def value_range(d: DataFrame, value: str, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    v = F.col(value)
    return d.groupBy("vol").agg(F.avg(F.greatest(lo - v, F.lit(0.0)) + F.greatest(v - hi, F.lit(0.0))).alias("loss"))


def wasserstein(h: DataFrame, bins: int, dark: float = 0.05) -> DataFrame:
    """h: vol, bin, a, b (counts). 200 times the L1 of the shares plus the L1 of their sums, over all and over bright bins."""
    start = min(int(dark * bins), bins - 1)
    parts = h.select("*", F.explode(F.when(F.col("bin") >= start, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("part"))
    w = W.partitionBy("vol", "part")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1e-8))
    p = parts.withColumns({"pa": share("a"), "pb": share("b")})
    run = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumns({"ca": F.sum("pa").over(run), "cb": F.sum("pb").over(run)})
    each = p.groupBy("vol", "part").agg((F.avg(F.abs(F.col("pa") - F.col("pb"))) * 200 + F.avg(F.abs(F.col("ca") - F.col("cb")))).alias("l"))
    return each.groupBy("vol").agg(F.sum("l").alias("loss"))


def local_variance(d: DataFrame, pred: str, target: str, side: int = 5) -> DataFrame:
    """L1 of the local standard deviations."""

    def std(c: str, name: str) -> DataFrame:
        m = Wn.box_mean(_only(d, F.col(c)), side).withColumnRenamed("v", "m1")
        q = Wn.box_mean(_only(d, F.col(c) * F.col(c)), side).withColumnRenamed("v", "m2")
        return m.join(q, _AT).select(*_AT, F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0)) + 1e-8).alias(name))

    return std(pred, "a").join(std(target, "b"), _AT).groupBy("vol").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("loss"))


def bernoulli_kl(p: Column, q: Column, eps: float = 1e-7) -> Column:
    p, q = (F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps)) for x in (p, q))
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def categorical_kl(p: Column, q: Column, eps: float = 1e-7) -> Column:
    """p and q: arrays of class probabilities."""
    term = lambda x, y: F.greatest(x, F.lit(eps)) * F.log(F.greatest(x, F.lit(eps)) / F.greatest(y, F.lit(eps)))
    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)


def total(parts: dict[float, DataFrame]) -> DataFrame:
    """Weighted sum of losses given as weight: (vol, loss)."""
    out = None
    for w, p in parts.items():
        p = p.select("vol", (F.col("loss") * w).alias("loss"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("vol").agg(F.sum("loss").alias("loss"))
