"""Reductions of volumes: histograms, percentiles, first-order statistics, label statistics, overlaps and features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.functions import rng
from scanframe.operators import windows as Wn


def unit_bin(v: Column, bins: int) -> Column:
    """Bin of a value in [0, 1]; bins are closed on the left, the last one on both sides."""
    return F.greatest(F.least(F.floor(v * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def soft_histogram(d: DataFrame, by: list[str], bins: int, lo: float = 0.0, hi: float = 1.0, mask: Column | None = None, eps: float = 1e-8) -> DataFrame:
    """Triangular-kernel counts: each value is shared by its two neighbouring bin centres; mass is kept."""
    pos = (F.col("v") - lo) / ((hi - lo) / max(bins - 1, 1) + eps)
    left = F.floor(pos)
    wl, wr = F.greatest(F.lit(0.0), F.least(left + 1 - pos, F.lit(1.0))), F.greatest(F.lit(0.0), F.least(pos - left, F.lit(1.0)))
    m = F.lit(1.0) if mask is None else mask.cast("double")
    clamp = lambda i: F.greatest(F.lit(0), F.least(i, F.lit(bins - 1))).cast("int")
    two = F.array(F.struct(clamp(left).alias("bin"), (wl * m).alias("w")), F.struct(clamp(left + 1).alias("bin"), (wr * m).alias("w")))
    return d.select(*by, F.inline(two)).groupBy(*by, "bin").agg(F.sum("w").alias("w"))


def histogram(d: DataFrame, by: list[str], bins: int, value: str = "v") -> DataFrame:
    """bin, n and share of the group for values in [0, 1]."""
    c = d.groupBy(*by, unit_bin(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))  # bins rows per group


def percentiles(d: DataFrame, by: list[str], qs: list[float], value: str = "v") -> DataFrame:
    return d.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("p"))


def normalise_p1_p99(d: DataFrame, by: list[str], value: str = "v", where: Column | None = None) -> DataFrame:
    """Clipped to the group's 1st and 99th percentile and rescaled to [0, 1]; groups without a spread are dropped."""
    p = percentiles(d if where is None else d.where(where), by, [0.01, 0.99], value).select(*by, F.col("p")[0].alias("_lo"), F.col("p")[1].alias("_hi")).where("_hi > _lo")
    return d.join(p, by).withColumn(value, F.greatest(F.lit(0.0), F.least((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(1.0)))).drop("_lo", "_hi")


def entropy(shares: DataFrame, by: list[str], base: float = 2.0) -> DataFrame:
    return shares.where("share > 0").groupBy(*by).agg((-F.sum(F.col("share") * F.log(base, "share"))).alias("entropy"))


def first_order(d: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """14 statistics of values in [0, 1]."""
    qs = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
    a = d.groupBy(*by).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"),
        F.percentile("v", F.array(*map(F.lit, qs))).alias("p"),
    )
    a = a.join(entropy(histogram(d, by, bins), by), by)
    names = [f"p{round(100 * q)}" for q in qs]
    cov = F.when(F.col("mean") > 1e-8, F.col("std") / F.col("mean")).otherwise(0.0)
    return a.select(*by, "mean", "std", "skew", "kurt", *[F.col("p")[k].alias(n) for k, n in enumerate(names)], "entropy", cov.alias("cov"), (F.col("p")[4] - F.col("p")[2]).alias("iqr"))


def radiomics_first_order(d: DataFrame, by: list[str], bins: int = 64, voxel_volume: float = 1.0, least: int = 50) -> DataFrame:
    """First-order radiomics of groups of at least so many voxels: fixed bin count between minimum and maximum."""
    s = d.groupBy(*by).agg(
        F.count("v").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"),
        F.skewness("v").alias("skewness"), (F.kurtosis("v") + 3).alias("kurtosis"), F.sum(F.col("v") * F.col("v")).alias("energy"),
        F.percentile("v", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("p"),
    ).where(F.col("n") >= least)
    j = d.join(s, by)
    inside = (F.col("v") >= F.col("p")[0]) & (F.col("v") <= F.col("p")[4])
    robust = j.where(inside).groupBy(*by).agg(F.avg("v").alias("_rm"))
    dev = j.join(robust, by).groupBy(*by).agg(F.avg(F.abs(F.col("v") - F.col("mean"))).alias("mad"), F.avg(F.when(inside, F.abs(F.col("v") - F.col("_rm")))).alias("robust_mad"))
    span = F.col("maximum") - F.col("minimum")
    bin_ = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("minimum")) / span * bins), F.lit(bins - 1))).otherwise(0)
    h = j.groupBy(*by, bin_.alias("bin")).agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    shape = h.groupBy(*by).agg((-F.sum(F.col("share") * F.log(2.0, "share"))).alias("entropy"), F.sum(F.col("share") * F.col("share")).alias("uniformity"))
    return s.join(dev, by).join(shape, by).select(
        *by, "n", "energy", (F.col("energy") * voxel_volume).alias("total_energy"), "entropy", "minimum", F.col("p")[0].alias("p10"), F.col("p")[4].alias("p90"), "maximum", "mean",
        F.col("p")[2].alias("median"), (F.col("p")[3] - F.col("p")[1]).alias("iqr"), span.alias("range"), "mad", "robust_mad", F.sqrt(F.col("energy") / F.col("n")).alias("rms"),
        "skewness", "kurtosis", "variance", "uniformity",
    )


def with_missing_groups(d: DataFrame, volumes: DataFrame, labels: list[int]) -> DataFrame:
    """A row for every volume and label; nulls where there was none."""
    every = volumes.select("vol").distinct().select("vol", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    return every.join(d, ["vol", "label"], "left")


def region_of(label: Column, table: dict[int, int], missing: int | None = 0) -> Column:
    """Lookup of a label in a fixed table."""
    m = F.create_map(*[x for kv in table.items() for x in map(F.lit, kv)])
    out = F.try_element_at(m, label)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def region_histogram(d: DataFrame, regions: int, bins: int, least: int) -> DataFrame:
    """share per (vol, region, bin) with region = regions for the whole brain; smaller regions give zeros."""
    n = normalise_p1_p99(d.where("region IS NOT NULL"), ["vol"])
    both = n.select("vol", F.explode(F.array("region", F.lit(regions))).alias("region"), "v")
    h = histogram(both, ["vol", "region"], bins)
    size = h.groupBy("vol", "region").agg(F.sum("n").alias("size"))
    grid = n.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0), F.lit(regions))).alias("region")).select("vol", "region", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(h, ["vol", "region", "bin"], "left").join(size, ["vol", "region"], "left")
    return out.select("vol", "region", "bin", F.when(F.col("size") >= least, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))


def masked_mean(by: list[str], d: DataFrame, mask: Column, eps: float = 1.0) -> DataFrame:
    """Sum inside the mask over max(count, eps)."""
    m = mask.cast("double")
    return d.groupBy(*by).agg((F.sum(F.col("v") * m) / F.greatest(F.sum(m), F.lit(eps))).alias("mean"))


def bounding_box(d: DataFrame, mask: Column) -> DataFrame:
    return d.where(mask).groupBy("vol").agg(*[f(a).alias(f"{n}_{a}") for a in Wn.AXES for f, n in ((F.min, "min"), (F.max, "max"))])


def nmi(d: DataFrame, by: list[str], a: str, b: str, bins: int = 64) -> DataFrame:
    """(H(a) + H(b)) / H(a, b) of the joint histogram over the range of each."""
    r = d.groupBy(*by).agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"), F.count(F.lit(1)).alias("_n"))

    def bin_(v: str, lo: str, hi: str) -> Column:
        span = F.col(hi) - F.col(lo)
        # a range of no width is widened by a half on both sides
        return F.when(span > 0, F.least(F.floor((F.col(v) - F.col(lo)) / span * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))

    h = d.join(r, by).groupBy(*by, bin_(a, "_a0", "_a1").alias("i"), bin_(b, "_b0", "_b1").alias("j")).agg((F.count(F.lit(1)) / F.first("_n")).alias("p"))
    eps = 1e-10
    ent = lambda x, keys: x.groupBy(*by, *keys).agg(F.sum("p").alias("p")).groupBy(*by).agg((-F.sum(F.col("p") * F.log(F.col("p") + eps))).alias("h"))
    ha, hb, hj = (ent(h, k).withColumnRenamed("h", n) for k, n in ((["i"], "ha"), (["j"], "hb"), (["i", "j"], "hj")))
    return ha.join(hb, by).join(hj, by).select(*by, ((F.col("ha") + F.col("hb")) / (F.col("hj") + eps)).alias("nmi"))


def confusion(d: DataFrame, by: list[str], label: int, pred: str = "pred", truth: str = "truth") -> DataFrame:
    p, t = F.col(pred) == label, F.col(truth) == label
    return d.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))


def dice(d: DataFrame, by: list[str], label: int, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """2 |P and G| / (|P| + |G|); null if both are empty."""
    c = confusion(d, by, label, pred, truth)
    return c.select(*by, (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("dice"))


def majority_vote(d: DataFrame, voxel: list[str], label: str) -> DataFrame:
    """The most frequent label of each voxel, the least one on a tie."""
    c = d.groupBy(*voxel, label).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*voxel).agg(F.max_by(label, F.struct("_c", -F.col(label))).alias("vote"))


def surface(d: DataFrame, mask: Column) -> DataFrame:
    """Voxels of the mask that lack at least one of their six neighbours in it."""
    inside = d.where(mask).select("vol", *Wn.AXES)
    for a in Wn.AXES:
        w = Wn.line(a)
        full = (F.coalesce(F.lag(a).over(w) == F.col(a) - 1, F.lit(False))) & (F.coalesce(F.lead(a).over(w) == F.col(a) + 1, F.lit(False)))
        inside = inside.withColumn(f"_f{a}", full)
    return inside.where(~(F.col("_fz") & F.col("_fy") & F.col("_fx"))).select("vol", *Wn.AXES)


def hd95(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The greater of both directions' 95th percentile of surface distances; volumes with an empty side are left out."""
    from scanframe.operators.neighbors import knn

    pack = lambda s: s.select(F.xxhash64("z", "y", "x").alias("id"), "vol", F.array(*[F.col(a).cast("double") for a in Wn.AXES]).alias("vec"))
    p, t = pack(pred), pack(truth)
    one = lambda a, b, n: knn(a, b, "id", "vec", 1, ["vol"]).groupBy("vol").agg(F.percentile("dist", 0.95).alias(n))
    return one(p, t, "a").join(one(t, p, "b"), "vol").select("vol", F.greatest("a", "b").alias("hd95"))


def inversion_score(d: DataFrame, by: list[str], value: str = "v", ref: str = "v") -> DataFrame:
    """Mean of value over the top tertile of ref less that over the bottom tertile."""
    t = d.groupBy(*by).agg(F.percentile(ref, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_t"))
    j = d.join(t, by)
    top, low = F.when(F.col(ref) >= F.col("_t")[1], F.col(value)), F.when(F.col(ref) <= F.col("_t")[0], F.col(value))
    return j.groupBy(*by).agg((F.avg(top) - F.avg(low)).alias("score"))


def dual_mask(d: DataFrame, least: int = 1000, side: int = 5) -> DataFrame:
    """mask: above the 3rd percentile of positive values and inside the smoothed envelope; all positives in small volumes."""
    t = d.where("v > 0").groupBy("vol").agg(F.percentile("v", 0.03).alias("_t"), F.count(F.lit(1)).alias("_n"))
    s = Wn.box_mean(d.withColumn("_v", F.col("v")), side, "reflect").withColumnRenamed("v", "_s").withColumnRenamed("_v", "v")
    j = s.join(t, "vol", "left")
    mask = F.when(F.coalesce("_n", F.lit(0)) < least, F.col("v") > 0).otherwise((F.col("v") > F.col("_t")) & (F.col("_s") > F.col("_t") * 0.5))
    return j.withColumn("mask", mask).drop("_t", "_n", "_s")


def otsu(h: DataFrame, by: list[str], bins: int) -> DataFrame:
    """The bin after which between-class variance is greatest (first on a tie), from histogram rows (bin, n)."""
    w = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    t = W.partitionBy(*by)
    x = (F.col("bin") + 0.5) / bins
    s = h.withColumns({"_w0": F.sum("n").over(w), "_s0": F.sum(F.col("n") * x).over(w), "_w": F.sum("n").over(t), "_s": F.sum(F.col("n") * x).over(t)})
    m0, m1 = F.col("_s0") / F.col("_w0"), F.try_divide(F.col("_s") - F.col("_s0"), F.col("_w") - F.col("_w0"))
    s = s.withColumn("between", F.coalesce(F.col("_w0") * (F.col("_w") - F.col("_w0")) * (m0 - m1) * (m0 - m1), F.lit(0.0)))
    return s.groupBy(*by).agg(F.max_by("bin", F.struct(F.round("between", 6), -F.col("bin"))).alias("bin"))


def fibonacci_half_sphere(n: int) -> list[tuple[float, float, float]]:
    golden = (1 + math.sqrt(5)) / 2
    out = []
    for i in range(n):
        z = i / max(n - 1, 1)
        phi, r = 2 * math.pi * i / golden, math.sqrt(max(1 - z * z, 0.0))
        norm = math.sqrt(r * r + z * z)
        out.append((r * math.cos(phi) / norm, r * math.sin(phi) / norm, z / norm))
    return out


def hog3d(d: DataFrame, cells: int = 4, orientations: int = 8) -> DataFrame:
    """Magnitude-weighted orientation histogram per cell of the bounding box, L2-normalised per cell: (vol, cell, orient, w)."""
    g = Wn.gradient(d)
    mag = F.sqrt(F.col("gz") ** 2 + F.col("gy") ** 2 + F.col("gx") ** 2)
    safe = F.greatest(mag, F.lit(1e-8))
    dots = [F.round(F.abs((F.col("gz") * a + F.col("gy") * b + F.col("gx") * c) / safe), 9) for a, b, c in fibonacci_half_sphere(orientations)]
    orient = F.array_position(F.array(*dots), F.array_max(F.array(*dots))) - 1
    box = bounding_box(d, F.lit(True))
    cell = F.lit(0)
    for a in Wn.AXES:
        lo, hi = F.col(f"min_{a}"), F.col(f"max_{a}")
        cell = cell * cells + F.least(F.floor((F.col(a) - lo) * cells / (hi - lo + 1)), F.lit(cells - 1))
    h = g.join(box, "vol").groupBy("vol", cell.cast("int").alias("cell"), orient.cast("int").alias("orient")).agg(F.sum(mag).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("vol", "cell")))
    return h.withColumn("w", F.col("w") / F.greatest(norm, F.lit(1e-8)))


def random_crop(d: DataFrame, sides: dict[str, int], seed: int) -> DataFrame:
    """A box of the given sides at a drawn place in each volume; a side longer than the volume keeps all of it."""
    top = d.groupBy("vol").agg(*[F.max(a).alias(f"_m{a}") for a in sides])
    j = d.join(top, "vol")
    for a, n in sides.items():
        start = F.floor(rng.uniform(seed, f"c{a}", "vol") * F.greatest(F.col(f"_m{a}") + 2 - n, F.lit(1)))
        j = j.where((F.col(a) >= start) & (F.col(a) <= start + n - 1))
    return j.drop(*[f"_m{a}" for a in sides])
