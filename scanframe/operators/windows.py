"""Window functions over bins and along the axes of a volume.

A volume is rows (vol, z, y, x, v, ...). Along an axis, rows of one line (equal vol and other coordinates) form the
window, so no window is longer than a side of the volume. Lines have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def cdf(d: DataFrame, by: list[str], order: str, weight: str, name: str = "cdf") -> DataFrame:
    """Running share of weight in order, within by."""
    w = W.partitionBy(*by)
    return d.withColumn(name, F.sum(weight).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) / F.greatest(F.sum(weight).over(w), F.lit(1e-8)))


def running_max(d: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    return d.withColumn(name, F.max(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def smooth_bins(d: DataFrame, by: list[str], order: str, value: str, sigma: float, radius: int, name: str) -> DataFrame:
    """Gaussian over neighbouring bins, zeros beyond the ends."""
    w = W.partitionBy(*by).orderBy(order)
    k = gaussian(radius, sigma)
    return d.withColumn(name, sum((F.coalesce(F.lag(value, -o).over(w), F.lit(0.0)) * k[o + radius] for o in range(-radius, radius + 1)), F.lit(0.0)))


def local_peaks(d: DataFrame, by: list[str], order: str, value: str, k: int) -> DataFrame:
    """The k highest places that are not below either neighbour; an end is its own neighbour."""
    w = W.partitionBy(*by).orderBy(order)
    v = F.col(value)
    peak = d.withColumn("_ok", (v >= F.coalesce(F.lag(value).over(w), v)) & (v >= F.coalesce(F.lead(value).over(w), v))).where("_ok").drop("_ok")
    return peak.withColumn("peak", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), order))).where(F.col("peak") <= k)


def trapezoid(d: DataFrame, by: list[str], x: str, y: str, name: str = "auc") -> DataFrame:
    w = W.partitionBy(*by).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return d.withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias(name))


def gaussian(radius: int, sigma: float) -> list[float]:
    k = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-radius, radius + 1)]
    return [x / sum(k) for x in k]


def line(axis: str, vol: str = "vol") -> W:
    return W.partitionBy(vol, *[a for a in AXES if a != axis]).orderBy(axis)


def gradient(d: DataFrame, value: str = "v", names: dict[str, str] | None = None) -> DataFrame:
    """Central differences along each axis, one-sided at the ends, 0 on a line of one voxel."""
    for a in AXES:
        before, after = F.lag(value).over(line(a)), F.lead(value).over(line(a))
        v = F.col(value)
        inner = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - v).when(before.isNotNull(), v - before).otherwise(F.lit(0.0))
        d = d.withColumn((names or {}).get(a, f"g{a}"), inner)
    return d


def filter_lines(d: DataFrame, weights: list[float], mode: str = "zero", value: str | tuple[str, ...] = "v", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Separable filter: along each axis, lines become arrays, are filtered and become rows again. Several values go along together;
    rows that are partitioned by vol stay where they are.

    mode: zero (nothing beyond the ends), replicate (the end value) or reflect (mirrored, the end value twice).
    """
    r = len(weights) // 2
    values = (value,) if isinstance(value, str) else value
    rest = [c for c in d.columns if c not in ("vol", *AXES, *values)]

    def place(i: Column, n: Column) -> Column:
        if mode == "replicate":
            return F.greatest(F.lit(0), F.least(i, n - 1))
        if mode == "reflect":
            m = F.pmod(i, 2 * n)
            return F.least(m, 2 * n - 1 - m)
        return F.when((i >= 0) & (i < n), i)

    for a in axes:
        others = [x for x in AXES if x != a]
        g = d.groupBy("vol", *others).agg(F.array_sort(F.collect_list(F.struct(a, *values, *rest))).alias("line"))
        g = g.select("vol", *others, "line", *[F.col("line")[v].alias(f"_line_{v}") for v in values])
        n = F.size("line")

        def filtered(v: str, i: Column) -> Column:
            line = F.col(f"_line_{v}")
            return sum((F.coalesce(F.get(line, place(i + o, n)), F.lit(0.0)) * weights[o + r] for o in range(-r, r + 1)), F.lit(0.0))  # noqa: B023

        new = F.transform("line", lambda e, i: F.struct(e[a].alias(a), *[filtered(v, i).alias(v) for v in values], *[e[c].alias(c) for c in rest]))  # noqa: B023
        d = g.select("vol", *others, F.inline(new))
    return d.select("vol", *AXES, *values, *rest)


def blur(d: DataFrame, sigma: float, radius: int | None = None, mode: str = "zero", value: str | tuple[str, ...] = "v") -> DataFrame:
    """Gaussian blur; the radius is int(3 * sigma + 0.5) unless given."""
    return filter_lines(d, gaussian(radius if radius is not None else max(1, int(3 * sigma + 0.5)), sigma), mode, value)


def box_mean(d: DataFrame, side: int, mode: str = "zero", value: str = "v") -> DataFrame:
    return filter_lines(d, [1 / side] * side, mode, value)


def sobel(d: DataFrame, value: str = "v", prefix: str = "") -> DataFrame:
    """gz, gy, gx (behind prefix): derivative along one axis, [1, 2, 1] along the others, zeros beyond the ends."""
    rest = [c for c in d.columns if c != value]
    base = d.withColumn("_v", F.col(value))
    for a in AXES:
        base = base.withColumn(value, F.col("_v"))
        for b in AXES:
            base = filter_lines(base, [-1.0, 0.0, 1.0] if a == b else [1.0, 2.0, 1.0], "zero", value, (b,))
        base = base.withColumn(f"{prefix}g{a}", F.col(value))
    return base.withColumn(value, F.col("_v")).select(*rest, value, *[f"{prefix}g{a}" for a in AXES])


def total_variation(d: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Sum over the axes of the mean absolute difference of neighbours."""
    for a in AXES:
        d = d.withColumn(f"_d{a}", F.abs(F.col(value) - F.lag(value).over(line(a))))
    return d.groupBy(*by).agg(sum((F.coalesce(F.avg(f"_d{a}"), F.lit(0.0)) for a in AXES), F.lit(0.0)).alias("tv"))
