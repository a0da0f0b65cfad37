"""Region-wise intensity remaps of volumes, with hash draws.

A generator cuts the foreground of every volume into regions (value chunks, one-dimensional clusters, nearest-seed
cells or labels), draws parameters per region and remaps values. Parameters are functions of (seed, tag, vol, region);
they are drawn once a region, beside its mean, and joined to the voxels. Background stays 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.functions import rng
from scanframe.operators import volume as V
from scanframe.operators import windows as Wn
from scanframe.operators.sampling import hash_sample
from scanframe.session import materialize

DARK = 0.01
EPS = 1e-6


def foreground(dark: float = DARK) -> Column:
    return F.col("v") > dark


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def minmax(d: DataFrame, value: str = "g", dark: float = DARK) -> DataFrame:
    """value rescaled to [0, 1] per volume; the range is that of value inside the foreground and of 0 outside; background is 0."""
    m = F.when(foreground(dark), F.col(value)).otherwise(0.0)
    s = d.groupBy("vol").agg(F.min(m).alias("_lo"), F.max(m).alias("_hi"))
    new = F.when(foreground(dark), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS)).otherwise(0.0)
    return d.join(s, "vol").withColumn(value, new).drop("_lo", "_hi")


def zscore_foreground(d: DataFrame, value: str, dark: float = DARK, eps: float = 1e-7, sample: bool = False) -> DataFrame:
    """z-scores inside the foreground, 0 outside; eps is added under the root."""
    x = F.when(foreground(dark), F.col(value))
    s = d.groupBy("vol").agg(F.avg(x).alias("_m"), (F.var_samp(x) if sample else F.var_pop(x)).alias("_v"))
    return d.join(s, "vol").withColumn(value, F.when(foreground(dark), (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).otherwise(0.0)).drop("_m", "_v")


def centre(d: DataFrame, sides: dict[str, tuple[int, int]]) -> DataFrame:
    """Coordinates moved so that a volume of the first side sits in the middle of one of the second; what falls out is cut."""
    for a, (old, new) in sides.items():
        d = d.withColumn(a, F.col(a) + ((new - old) // 2 if new >= old else -((old - new) // 2))).where((F.col(a) >= 0) & (F.col(a) < new))
    return d


def interp(x: Column, xs: list[Column], ys: list[Column]) -> Column:
    """Piecewise-linear interpolation with clamped ends; xs ascending."""
    out = ys[-1]
    for k in range(len(xs) - 1, 0, -1):
        t = F.coalesce((x - xs[k - 1]) / F.nullif(xs[k] - xs[k - 1], F.lit(0.0)), F.lit(0.0))
        out = F.when(x <= xs[k], ys[k - 1] + t * (ys[k] - ys[k - 1])).otherwise(out)
    return F.when(x <= xs[0], ys[0]).otherwise(out)


def bezier(x: Column, seed: int, p: float = 0.5) -> Column:
    """Cubic tone curve from 0 to 1 with drawn controls, applied with probability p."""
    a, b = rng.uniform(seed, "b1", "vol"), rng.uniform(seed, "b2", "vol")
    return F.when(rng.gate(p, seed, "bz", "vol"), 3 * (1 - x) * (1 - x) * x * a + 3 * (1 - x) * x * x * b + x * x * x).otherwise(x)


def chunk_of(x: Column, edges: Column) -> Column:
    """Chunk k holds (edge k, edge k + 1]; the ends are clamped."""
    n = F.size(F.filter(edges, lambda e: e < x))
    return F.greatest(F.lit(0), F.least(n - 1, F.size(edges) - 2))


def uniform_edges(k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k), lambda i: i / k)


def quantile_edges(d: DataFrame, ks: list[int], seed: int, dark: float = DARK) -> DataFrame:
    """vol, k, edges: K drawn from ks, quantiles of the foreground with the ends 0 and 1; even ones if the foreground has under K + 1 values."""
    fg = F.when(foreground(dark), F.col("v"))
    most = {n: F.percentile(fg, F.array(*[F.lit(i / n) for i in range(n + 1)])) for n in sorted(set(ks))}
    q = d.groupBy("vol").agg(F.count(fg).alias("_n"), *[c.alias(f"_q{n}") for n, c in most.items()]).withColumn("k", rng.choice(ks, seed, "K", "vol"))
    edges = F.lit(None).cast("array<double>")
    for n in most:
        edges = F.when(F.col("k") == n, F.concat(F.array(F.lit(0.0)), F.slice(f"_q{n}", 2, n - 1), F.array(F.lit(1.0)))).otherwise(edges)
    return q.select("vol", "k", F.when(F.col("_n") > F.col("k"), edges).otherwise(uniform_edges(F.col("k"))).alias("edges"))


def signed(seed: int, tag: str, *ids) -> Column:
    """Magnitude in [0.5, 2), sign by a fair draw."""
    return rng.between(0.5, 2.0, seed, tag, *ids) * F.when(rng.uniform(seed, tag + "s", *ids) > 0.5, 1.0).otherwise(-1.0)


def affine_by_region(d: DataFrame, mu: Column, alpha: Column, dark: float = DARK, needs: tuple[str, ...] = ()) -> DataFrame:
    """g = mu + alpha * (v - mean of v in the region's foreground). mu and alpha are computed once a region, from vol, region and the
    columns that needs names, which are equal throughout a region."""
    fg = foreground(dark)
    mean = F.sum(F.when(fg, F.col("v")).otherwise(0.0)) / F.greatest(F.count_if(fg), F.lit(1))
    means = d.groupBy("vol", "region").agg(mean.alias("_m"), *[F.first(c).alias(c) for c in needs])
    drawn = means.select("vol", "region", "_m", mu.alias("_mu"), alpha.cast("double").alias("_al"))
    return d.join(drawn, ["vol", "region"]).withColumn("g", F.when(fg, F.col("_mu") + F.col("_al") * (F.col("v") - F.col("_m"))).otherwise(0.0)).drop("_m", "_mu", "_al")


def chunk_levels(d: DataFrame, ks: list[int], seed: int, even: bool = False, levels: list[tuple[float, float]] | None = None, alpha: tuple[float, float] = (0.5, 2.0), falling: bool = False, dark: float = DARK) -> DataFrame:
    """Values cut at quantiles of the foreground (or evenly), each chunk remapped about its middle: level + alpha * (v - middle),
    clamped. Levels are drawn from [0, 1] or from a range per chunk, and fall from chunk to chunk on demand. Result in g."""
    e = d.select("vol").distinct().withColumn("k", rng.choice(ks, seed, "K", "vol")).withColumn("edges", uniform_edges(F.col("k"))) if even else quantile_edges(d, ks, seed, dark)
    each = F.sequence(F.lit(0), F.col("k") - 1)
    level = F.transform(each, lambda i: rng.uniform(seed, "mu", F.col("vol"), i)) if levels is None else F.array(*[rng.between(lo, hi, seed, "mu", F.col("vol"), F.lit(i)) for i, (lo, hi) in enumerate(levels)])
    e = e.select(
        "vol", "edges", (F.sort_array(level, asc=False) if falling else level).alias("_mu"), F.transform(each, lambda i: rng.between(*alpha, seed, "alpha", F.col("vol"), i)).alias("_al"),
        F.transform(each, lambda i: (F.get("edges", i) + F.get("edges", i + 1)) / 2).alias("_mid"),
    )
    e = e.select("vol", "edges", F.explode(F.array(F.struct("_mu", "_al", "_mid"))).alias("_p"))  # drawn once a volume
    j = d.join(e, "vol").withColumn("_r", chunk_of(F.col("v"), F.col("edges")))
    of = lambda c: F.get(F.col(f"_p.{c}"), F.col("_r"))
    return j.withColumn("g", F.when(foreground(dark), clamp01(of("_mu") + of("_al") * (F.col("v") - of("_mid")))).otherwise(0.0)).drop("edges", "_p", "_r")


def chunk_swap(d: DataFrame, k: int, seed: int, dark: float = DARK) -> DataFrame:
    """Foreground quantile chunks moved to each other's ranges by a drawn permutation; the background stays. Result in g."""
    q = F.percentile(F.when(foreground(dark), F.col("v")), F.array(*[F.lit(i / k) for i in range(k + 1)]))
    e = d.groupBy("vol").agg(q.alias("_q"))
    ends = F.concat(F.array(F.least(F.get("_q", F.lit(0)), F.lit(dark))), F.slice("_q", 2, k - 1), F.array(F.greatest(F.element_at("_q", -1), F.lit(1.0))))
    order = F.array_sort(F.array(*[F.struct(rng.uniform(seed, "mu", F.col("vol"), F.lit(i)).alias("u"), F.lit(i).alias("i")) for i in range(k)]))
    e = e.select("vol", F.explode(F.array(F.struct(ends.alias("edges"), F.transform(order, lambda x: x["i"]).alias("to")))).alias("_p"))
    j = d.join(e, "vol").withColumn("_r", chunk_of(F.col("v"), F.col("_p.edges")))
    at = lambda i: F.get(F.col("_p.edges"), i)
    to, r = F.get(F.col("_p.to"), F.col("_r")), F.col("_r")
    t = (F.col("v") - at(r)) / F.greatest(at(r + 1) - at(r), F.lit(1e-8))
    return j.withColumn("g", F.when(foreground(dark), clamp01(at(to) + t * (at(to + 1) - at(to)))).otherwise(F.col("v"))).drop("_p", "_r")


def kmeans_1d(d: DataFrame, cs: list[int], seed: int, iterations: int = 10, sample: int = 10_000, dark: float = DARK) -> DataFrame:
    """vol, c, centroids (ascending): Lloyd steps from an even start over at most so many foreground values of each
    volume, as higher-order functions over one bounded array per volume. An empty cluster keeps its centroid."""
    some = hash_sample(d.where(foreground(dark)), ["vol"], sample, seed, "km", "vol", "i").select("vol", "v")
    a = some.groupBy("vol").agg(F.array_sort(F.collect_list("v")).alias("vals")).withColumn("c", rng.choice(cs, seed, "C", "vol"))
    lo, hi = F.get("vals", F.lit(0)), F.element_at("vals", -1)
    start = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: lo + (hi - lo) * i / F.greatest(F.col("c") - 1, F.lit(1))).cast("array<double>")

    def step(m: Column, _: Column) -> Column:
        # centroids stay in order, so a cluster is what lies between the midpoints; ties go to the lower one
        half = lambda a, b: (F.get(m, a) + F.get(m, b)) / 2
        inside = lambda x, j: F.coalesce(x <= half(j, j + 1), F.lit(True)) & F.coalesce(x > half(j - 1, j), F.lit(True))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        add = lambda t, x: F.struct((t["s"] + x).alias("s"), (t["n"] + 1).alias("n"))
        mean = lambda old, j: F.aggregate(F.filter("vals", lambda x: inside(x, j)), zero, add, lambda t: F.when(t["n"] > 0, t["s"] / t["n"]).otherwise(old))
        return F.transform(m, mean).cast("array<double>")

    a = a.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step))
    return a.select("vol", "c", F.col("m").alias("centroids"))


def cluster_of(x: Column, centroids: Column) -> Column:
    """The nearest centroid of an ascending array; the lower one on a tie."""
    mids = F.transform(F.slice(centroids, 2, F.size(centroids)), lambda m, i: (m + F.get(centroids, i)) / 2)
    return F.size(F.filter(mids, lambda m: m < x))


def voronoi(d: DataFrame, ss: list[int], seed: int, skip: float = 0.4, dark: float = DARK) -> DataFrame:
    """cell of each voxel in its cluster: the nearest of S drawn foreground voxels (the earlier seed on a tie); a skipped cluster is whole."""
    ids = ["vol", "cluster"]
    whole = rng.gate(skip, seed, "skip", *ids)
    fg = d.where(foreground(dark))
    seeds = hash_sample(fg, ids, rng.choice(ss, seed, "S", *ids), seed, "seed", "vol", "i")
    s = seeds.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("si"), F.col("z").alias("sz"), F.col("y").alias("sy"), F.col("x").alias("sx")))).alias("seeds"))  # at most max(ss)
    far = lambda e: (e["sz"] - F.col("z")) ** 2 + (e["sy"] - F.col("y")) ** 2 + (e["sx"] - F.col("x")) ** 2
    nearest = F.array_min(F.transform("seeds", lambda e, k: F.struct(far(e).alias("d"), k.alias("k"))))["k"]
    return d.join(s, ids, "left").withColumn("cell", F.when(whole | F.col("seeds").isNull() | (F.size("seeds") < 2), 0).otherwise(nearest)).drop("seeds")


@dataclass(frozen=True)
class Version:
    """What a clustering generator draws; the names of VERSIONS are those users know."""

    cs: tuple[int, ...] = (2, 3, 4, 5, 6)
    ss: tuple[int, ...] = tuple(range(2, 11))
    skip_all: float = 0.1
    skip_cells: float = 0.4
    sign: bool = True
    constant: float = 0.0
    cells: bool = True
    mu: str = "region"
    normalise: bool = True
    post: str | None = None
    passes: int = 1


_MANY = (8, 10, 12, 16)
VERSIONS = {
    "raw": Version(normalise=False),
    "v26_1": Version(skip_all=0.0, skip_cells=0.0, sign=False, normalise=False),
    "v26_2": Version(skip_all=0.3, sign=False, normalise=False),
    "v26_3": Version(sign=False),
    "v26_4": Version(sign=False),
    "v26_5": Version(sign=False, mu="polar"),
    "v26_6": Version(),
    "v26_7": Version(constant=1.0),
    "v26_8": Version(post="invert"),
    "v26_9": Version(post="gamma"),
    "v26_10": Version(post="noise"),
    "v26_11": Version(skip_all=0.05, cs=_MANY, cells=False),
    "v26_12": Version(skip_all=0.05, mu="stratified"),
    "v26_13": Version(skip_all=0.05, cs=_MANY, cells=False, mu="stratified"),
    "v26_14": Version(skip_all=0.05, mu="class", constant=0.4),
    "v26_15": Version(passes=2),
    "v28_1": Version(post="rician"),
    "v28_2": Version(),
    "v28_3": Version(post="dropout"),
    "v28_4": Version(post="dropout"),
}


def _post(d: DataFrame, kind: str, seed: int, dark: float) -> DataFrame:
    fg, y = foreground(dark), F.col("g")
    if kind == "invert":
        new = F.when(rng.gate(0.5, seed, "inv", "vol"), 1 - y).otherwise(y)
    elif kind == "gamma":
        new = F.pow(y, rng.log_uniform(0.25, 4.0, seed, "gamma", "vol"))
    elif kind == "noise":
        d = fractal_noise(d, seed)
        new = clamp01(y + rng.between(0.05, 0.25, seed, "sd", "vol") * F.col("noise"))
    elif kind == "rician":
        sd = rng.between(0.0, 0.12, seed, "sd", "vol")
        new = F.sqrt((y + sd * rng.normal(seed, "n1", "vol", "i")) ** 2 + (sd * rng.normal(seed, "n2", "vol", "i")) ** 2)
    else:  # signal lost at the low end of z and, less, at both ends of x
        far = d.groupBy("vol").agg(F.max("z").alias("_z"), F.max("x").alias("_x"))
        d = d.join(far, "vol")
        share = lambda a: F.col(a) / F.greatest(F.col(f"_{a}"), F.lit(1))
        sigmoid = lambda t: 1 / (1 + F.exp(-t))
        lost = 0.75 * sigmoid(-30 * (share("z") - 0.30)) + 0.25 * sigmoid(25 * (F.abs(share("x") - 0.5) - 0.38))
        lost = clamp01(lost) * rng.between(0.0, 0.80, seed, "amount", "vol")
        new = F.when(rng.gate(0.7, seed, "drop", "vol"), y * (1 - lost)).otherwise(y)
    d = d.withColumn("g", F.when(fg, new).otherwise(0.0)).drop("_z", "_x", "noise")
    return minmax(d, "g", dark) if kind == "rician" else d


def _regions(d: DataFrame, o: Version, seed: int, dark: float, centres: DataFrame | None = None) -> DataFrame:
    """Adds c, whole (the volume is one region), klass (its cluster, 0 if whole) and region."""
    centres = kmeans_1d(d, list(o.cs), seed, dark=dark) if centres is None else centres
    j = d.join(centres, "vol").withColumn("cluster", cluster_of(F.col("v"), F.col("centroids")))
    j = voronoi(j, list(o.ss), seed, o.skip_cells, dark) if o.cells else j.withColumn("cell", F.lit(0))
    j = j.withColumn("whole", rng.gate(o.skip_all, seed, "all", "vol")).withColumn("klass", F.when(F.col("whole"), 0).otherwise(F.col("cluster")))
    j = j.withColumn("region", F.when(F.col("whole"), 0).otherwise(F.col("cluster") * 100 + F.col("cell")))
    return materialize(j.drop("centroids", "cluster", "cell"), "regions")  # read several times


def _remapped(j: DataFrame, o: Version, seed: int, dark: float) -> DataFrame:
    mu = rng.uniform(seed, "mu", "vol", "region")
    of_class = rng.uniform(seed, "mu", "vol", "klass")
    each = lambda tag: F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(rng.uniform(seed, tag, F.col("vol"), i).alias("u"), i.alias("i")))
    if o.mu == "class":
        mu = of_class
    elif o.mu == "polar":  # clusters share a value; in half of the volumes the values fall with the centroids
        fall = F.get(F.sort_array(each("mu"), asc=False), F.col("klass"))["u"]
        mu = F.when(~F.col("whole") & rng.gate(0.5, seed, "anti", "vol"), fall).otherwise(of_class)
    elif o.mu == "stratified":  # one band of [0, 1] for each cluster, in drawn order
        mu = F.when(F.col("whole"), of_class).otherwise((F.get(F.array_sort(each("band")), F.col("klass"))["i"] + of_class) / F.col("c"))
    alpha = signed(seed, "alpha", "vol", "region") if o.sign else rng.between(0.5, 2.0, seed, "alpha", "vol", "region")
    if o.constant:
        flat = rng.gate(o.constant, seed, "const", "vol", "klass") & (F.lit(o.constant >= 1) | ~F.col("whole"))
        alpha = F.when(flat, 0.0).otherwise(alpha)
    return materialize(affine_by_region(j, mu, alpha, dark, ("c", "whole", "klass")).drop("c", "whole", "klass", "region"), "remapped")


def parcellation_remap(d: DataFrame, version: str, seed: int = 42, dark: float = DARK) -> DataFrame:
    """g for every voxel by a clustering generator: clusters of the foreground, cells in them, an affine remap per cell. A second
    pass takes the first one's result for its input, foreground included."""
    o = VERSIONS[version]
    j = d.withColumn("_v", F.col("v"))
    for k in range(o.passes):
        j = j if k == 0 else j.withColumn("v", F.col("g")).drop("g")
        j = _remapped(_regions(j, o, seed + k, dark), o, seed + k, dark)
        j = minmax(j, "g", dark) if o.normalise else j
    j = _post(j, o.post, seed, dark) if o.post else j
    return j.withColumn("v", F.col("_v")).drop("_v")


def label_texture(d: DataFrame, seed: int, labels: tuple[int, ...] = (1, 2, 3), dark: float = DARK) -> DataFrame:
    """Eight even chunks remapped about their centres, then with probability one half a label's voxels about the label's mean;
    normalised. Result in g."""
    fg = foreground(dark)
    chunk = F.greatest(F.lit(0), F.least(F.ceil(F.col("v") * 8) - 1, F.lit(7))).cast("int")
    own = d.withColumn("_c", chunk)
    base = rng.uniform(seed, "mu", "vol", "_c") + rng.between(0.5, 2.0, seed, "alpha", "vol", "_c") * (F.col("v") - (F.col("_c") + 0.5) / 8)
    means = d.where(F.col("label").isin(*labels)).groupBy("vol", "label").agg(F.avg("v").alias("_m"))
    drawn = means.select("vol", "label", "_m", rng.uniform(seed, "lmu", "vol", "label").alias("_mu"), rng.between(0.5, 2.0, seed, "lalpha", "vol", "label").alias("_al"), (rng.uniform(seed, "use", "vol", "label") > 0.5).alias("_use"))
    j = own.join(drawn, ["vol", "label"], "left")
    over = F.col("_mu") + F.col("_al") * (F.col("v") - F.col("_m"))
    return minmax(j.withColumn("g", F.when(fg, F.when(F.col("_use"), over).otherwise(base)).otherwise(0.0)).drop("_c", "_m", "_mu", "_al", "_use"), "g", dark)


def label_affine(d: DataFrame, seed: int, value: str = "v", p: float = 1.0, least: int = 1, dark: float = DARK, sign: bool = True, mask: Column | None = None) -> DataFrame:
    """Per label over 0 with enough voxels: a drawn affine remap of value, with probability p; others keep it. Result in g;
    a signed remap is clamped."""
    fg = (foreground(dark) if mask is None else mask) & (F.col("label") > 0)
    s = d.where(fg).groupBy("vol", "label").agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    alpha = signed(seed, "lalpha", "vol", "label") if sign else rng.between(0.5, 2.0, seed, "lalpha", "vol", "label")
    s = s.select("vol", "label", "_m", "_n", rng.uniform(seed, "lmu", "vol", "label").alias("_mu"), alpha.alias("_al"), rng.gate(p, seed, "use", "vol", "label").alias("_gate"))
    j = d.join(s, ["vol", "label"], "left")
    new = F.col("_mu") + F.col("_al") * (F.col(value) - F.col("_m"))
    return j.withColumn("g", F.when(fg & (F.col("_n") >= least) & F.col("_gate"), clamp01(new) if sign else new).otherwise(F.col(value))).drop("_m", "_n", "_mu", "_al", "_gate")


def synthseg_labels(d: DataFrame, seed: int, labels: tuple[int, ...] = (1, 2, 3), dark: float = DARK) -> DataFrame:
    """Labels replaced by Gaussians of drawn mean and deviation; the rest keeps its value. Result in g."""
    draw = clamp01(rng.uniform(seed, "gm", "vol", "label") + rng.between(0.02, 0.15, seed, "gs", "vol", "label") * rng.normal(seed, "gn", "vol", "i"))
    return d.withColumn("g", F.when(F.col("label").isin(*labels) & foreground(dark), draw).when(foreground(dark), F.col("v")).otherwise(0.0))


def label_chunks(d: DataFrame, seed: int, ks: tuple[int, ...] = (2, 3, 4, 6, 8), least: int = 100, dark: float = DARK) -> DataFrame:
    """Per label over 0 of at least so many voxels: a drawn number of quantile chunks, an affine remap each; normalised. Result in g."""
    fg = foreground(dark) & (F.col("label") > 0)
    most = {n: F.percentile("v", F.array(*[F.lit(i / n) for i in range(n + 1)])).alias(f"_q{n}") for n in ks}
    q = d.where(fg).groupBy("vol", "label").agg(F.count(F.lit(1)).alias("_n"), *most.values()).withColumn("_k", rng.choice(list(ks), seed, "K", "vol", "label"))
    edges = F.lit(None).cast("array<double>")
    for n in ks:
        edges = F.when(F.col("_k") == n, F.col(f"_q{n}")).otherwise(edges)
    j = d.join(q.select("vol", "label", "_n", edges.alias("_e")), ["vol", "label"], "left").withColumn("_use", F.coalesce(fg & (F.col("_n") >= least), F.lit(False)))
    j = j.withColumn("region", F.when(F.col("_use"), F.col("label") * 100 + chunk_of(F.col("v"), F.col("_e"))).otherwise(-1))
    j = affine_by_region(j, rng.uniform(seed, "mu", "vol", "region"), rng.between(0.5, 2.0, seed, "alpha", "vol", "region"), dark)
    j = j.withColumn("g", F.when(F.col("_use"), F.col("g")).when(foreground(dark), F.col("v")).otherwise(0.0))
    return minmax(j, "g", dark).drop("_e", "_n", "_use", "region")


def knot_map(d: DataFrame, seed: int, adaptive: bool, dark: float = 0.02) -> DataFrame:
    """A map that rises to a peak, falls to a dip and rises to 1, at drawn places, or at drawn ranks of the foreground (of 100 values at
    least, else all is 0). Result in g."""
    draw = lambda lo, hi, tag: rng.between(lo, hi, seed, tag, "vol")
    if adaptive:
        s = d.where(foreground(dark)).groupBy("vol").agg(F.array_sort(F.collect_list("v")).alias("_s"))
        at = lambda q: F.get("_s", F.least(F.floor(q * F.size("_s")), F.size("_s") - 1).cast("int"))
        s = s.select("vol", F.size("_s").alias("_n"), at(draw(0.55, 0.75, "q2")).alias("_x2"), at(draw(0.75, 0.90, "q3")).alias("_x3"), draw(0.68, 0.80, "top").alias("_top"), draw(0.50, 0.70, "ratio").alias("_dip"))
        s = s.withColumns({"_x1": F.lit(dark), "_x3": F.when(F.col("_x2") >= F.col("_x3"), F.col("_x2") + 1e-4).otherwise(F.col("_x3")), "_dip": F.col("_dip") * F.col("_top")})
    else:
        s = d.select("vol").distinct().select("vol", F.lit(100).alias("_n"), draw(0.05, 0.15, "x1").alias("_x1"), draw(0.30, 0.50, "x2").alias("_x2"), draw(0.60, 0.80, "x3").alias("_x3"), draw(0.65, 0.80, "top").alias("_top"), draw(0.45, 0.62, "dip").alias("_dip"))
    j, v = d.join(s, "vol", "left"), F.col("v")
    up = (v - F.col("_x1")) / (F.col("_x2") - F.col("_x1")) * F.col("_top")
    down = F.col("_top") + (v - F.col("_x2")) / (F.col("_x3") - F.col("_x2")) * (F.col("_dip") - F.col("_top"))
    last = F.col("_dip") + (v - F.col("_x3")) / F.greatest(1 - F.col("_x3"), F.lit(1e-4)) * (1 - F.col("_dip"))
    y = F.when(v < F.col("_x1"), 0.0).when(v < F.col("_x2"), up).when(v < F.col("_x3"), down).otherwise(last)
    return j.withColumn("g", F.when(foreground(dark) & (F.col("_n") >= 100), clamp01(y)).otherwise(0.0)).drop(*[f"_{c}" for c in ("n", "x1", "x2", "x3", "top", "dip")])


def ellipsoids(d: DataFrame, seed: int, ks: list[int], n: int = 3, radius: tuple[float, float] = (15.0, 80.0), dark: float = DARK) -> DataFrame:
    """Up to n ellipsoids about drawn foreground voxels, with radii in voxels, each with a chunk remap of its own over that of the
    rest. Result in g, clamped."""
    remap = lambda s: chunk_levels(d, ks, s, even=True, dark=dark)
    out = remap(seed)
    for b in range(n):
        middle = hash_sample(d.where(foreground(dark)), ["vol"], 1, seed, f"middle{b}", "vol", "i").select("vol", *[F.col(a).alias(f"_m{a}") for a in Wn.AXES])
        far = sum((((F.col(a) - F.col(f"_m{a}")) / rng.between(*radius, seed, f"r{b}{a}", "vol")) ** 2 for a in Wn.AXES), F.lit(0.0))
        inside = (far <= 1) & (rng.uniform(seed, "blobs", "vol") * (n + 1) > b + 1)
        own = remap(seed + 1 + b).select("vol", "i", F.col("g").alias("_y"))
        out = out.join(middle, "vol").join(own, ["vol", "i"]).withColumn("g", F.when(inside, F.col("_y")).otherwise(F.col("g"))).drop("_y", *[f"_m{a}" for a in Wn.AXES])
    return out.withColumn("g", F.when(foreground(dark), clamp01(F.col("g"))).otherwise(0.0))


def histogram_peaks(d: DataFrame, bins: int = 64, k: int = 4) -> DataFrame:
    """centres of each volume: the k highest local maxima of its smoothed soft histogram."""
    grid = d.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = grid.join(V.soft_histogram(d, ["vol"], bins), ["vol", "bin"], "left").select("vol", "bin", F.coalesce("w", F.lit(0.0)).alias("w"))
    h = Wn.smooth_bins(h, ["vol"], "bin", "w", 1.0, 3, "s").withColumn("s", F.round("s", 9))
    return Wn.local_peaks(h, ["vol"], "bin", "s", k).groupBy("vol").agg(F.transform(F.array_sort(F.collect_list(F.struct("peak", "bin"))), lambda e: e["bin"] / (bins - 1)).alias("centres"))


def rbf_targets(d: DataFrame, seed: int, peaks: DataFrame, temperature: float = 0.01, noise: float = 0.0, dark: float = DARK) -> DataFrame:
    """Softmax of -(v - centre)^2 / temperature over each volume's centres (array column centres), times drawn targets. Result in g."""
    j = d.join(peaks.withColumn("_t", F.transform("centres", lambda c, k: rng.uniform(seed, "target", F.col("vol"), k))), "vol")
    near = F.array_max(F.transform("centres", lambda c: -(F.col("v") - c) * (F.col("v") - c) / temperature))
    j = j.withColumn("_near", near)
    w = F.transform("centres", lambda c: F.exp(-(F.col("v") - c) * (F.col("v") - c) / temperature - F.col("_near")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    y = total(F.zip_with(w, "_t", lambda a, b: a * b)) / total(w)
    if noise:
        y = y + noise * rng.normal(seed, "rn", "vol", "i")
    return j.withColumn("g", F.when(foreground(dark), clamp01(y)).otherwise(0.0)).drop("centres", "_t", "_near")


def soft_quantiles(d: DataFrame, seed: int, k: int = 5, temperature: float = 0.05, noise: float = 0.02, dark: float = 1e-4) -> DataFrame:
    """Voxels softly assigned to k quantiles of the whole volume, each with a drawn target. Result in g."""
    centres = d.groupBy("vol").agg(F.percentile("v", F.array(*[F.lit((j + 0.5) / k) for j in range(k)])).alias("centres"))
    return rbf_targets(d, seed, centres, temperature, noise, dark)


def interp_array(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation through ascending xs (arrays); beyond the ends the end values, at repeated xs the last one's."""
    k = F.size(F.filter(xs, lambda e: e <= x))
    last = F.size(xs)
    at = lambda a, i: F.get(a, i)
    t = (x - at(xs, k - 1)) / (at(xs, k) - at(xs, k - 1))
    return F.when(k == 0, at(ys, F.lit(0))).when(k == last, at(ys, last - 1)).otherwise(at(ys, k - 1) + t * (at(ys, k) - at(ys, k - 1)))


def gmm_match(d: DataFrame, seed: int, quantiles: int = 100, bins: int = 100, peaks: tuple[int, int] = (3, 6), dark: float = 1e-4) -> DataFrame:
    """The histogram of each volume's tissue (v over dark) matched to a drawn mixture of Gaussians; background exactly 0. Result in g."""
    q = [i / (quantiles - 1) for i in range(quantiles)]
    tissue = F.percentile(F.when(F.col("v") > dark, F.col("v")), F.array(*map(F.lit, q)))
    every = F.percentile("v", F.array(*map(F.lit, q)))
    s = d.groupBy("vol").agg(F.when(F.count_if(F.col("v") > dark) >= 2, tissue).otherwise(every).alias("_xs"))
    count = rng.choice(list(range(peaks[0], peaks[1] + 1)), seed, "peaks", "vol")
    draw = lambda tag, i: rng.uniform(seed, tag, F.col("vol"), i)
    part = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(draw("gm", i).alias("m"), (0.02 + 0.08 * draw("gs", i)).alias("s"), (0.1 + 0.9 * draw("gw", i)).alias("w")))
    s = s.withColumn("_parts", F.explode(F.array(part)))  # drawn once a volume
    centre = F.array(*[F.lit(i / (bins - 1)) for i in range(bins)])
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    pdf = F.transform(centre, lambda c: total("_parts", lambda p: p["w"] / p["s"] * F.exp(-0.5 * ((c - p["m"]) / p["s"]) ** 2)))
    s = s.withColumn("_pdf", F.explode(F.array(pdf)))
    grown = F.aggregate("_pdf", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    s = s.withColumn("_cdf", F.explode(F.array(grown)))
    cdf = F.transform("_cdf", lambda x: x / F.element_at("_cdf", -1))
    s = s.withColumn("_cdf", F.explode(F.array(cdf)))
    s = s.select("vol", "_xs", F.transform(F.array(*map(F.lit, q)), lambda x: interp_array(x, F.col("_cdf"), centre)).alias("_ys"))
    j = d.join(s, "vol")
    return j.withColumn("g", F.when(F.col("v") > dark, clamp01(interp_array(F.col("v"), F.col("_xs"), F.col("_ys")))).otherwise(0.0)).drop("_xs", "_ys")


def unsharp(d: DataFrame, amount: float, sigma: float) -> DataFrame:
    """g = v + amount * (v - blurred v), clamped."""
    b = Wn.blur(d.withColumn("_v", F.col("v")), sigma)
    return b.withColumn("g", clamp01(F.col("_v") + amount * (F.col("_v") - F.col("v")))).withColumn("v", F.col("_v")).drop("_v")


def pyramid(d: DataFrame, seed: int, sigmas: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """Three levels by two blurs: the low band affinely re-targeted, the details scaled by draws in [0.8, 1.2). Result in g."""
    b = Wn.blur(d.withColumn("_v", F.col("v")), sigmas[0]).withColumn("_b", F.col("v"))
    b = Wn.blur(b, sigmas[1])
    s = [rng.between(0.8, 1.2, seed, f"d{k}", "vol") for k in range(2)]
    low = rng.between(0.5, 1.0, seed, "la", "vol") * F.col("v") + rng.between(0.0, 0.3, seed, "lb", "vol")
    y = low + s[0] * (F.col("_b") - F.col("v")) + s[1] * (F.col("_v") - F.col("_b"))
    return b.withColumn("g", clamp01(y)).withColumn("v", F.col("_v")).drop("_v", "_b")


def lerp_noise(seed: int, tag: str, scale: int) -> Column:
    """Normal noise on a grid of the given spacing, linear between its points along all axes."""
    out = F.lit(0.0)
    for corner in range(8):
        w, ids = F.lit(1.0), []
        for b, a in enumerate(Wn.AXES):
            lo = F.floor(F.col(a) / scale)
            t = F.col(a) / scale - lo
            high = corner >> b & 1
            w = w * (t if high else 1 - t)
            ids.append(lo + high)
        out = out + w * rng.normal(seed, f"{tag}{scale}", "vol", *ids)
    return out


def fractal_noise(d: DataFrame, seed: int, scales: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """noise in [-0.5, 0.5] per volume: interpolated normal noise of several scales, each over its scale."""
    n = d.withColumn("noise", sum((lerp_noise(seed, "f", s) / s for s in scales), F.lit(0.0)))
    r = n.groupBy("vol").agg(F.min("noise").alias("_lo"), F.max("noise").alias("_hi"))
    return n.join(r, "vol").withColumn("noise", (F.col("noise") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS) - 0.5).drop("_lo", "_hi")


def anisotropic(d: DataFrame, factor: int) -> DataFrame:
    """Depth averaged over blocks and brought back linearly (end blocks are held). Result in g."""
    blocks = d.groupBy("vol", "y", "x", F.floor(F.col("z") / factor).alias("_b")).agg(F.avg("v").alias("_a"))
    last = blocks.groupBy("vol", "y", "x").agg(F.max("_b").alias("_last"))
    pos = (F.col("z") + 0.5) / factor - 0.5
    j = d.join(last, ["vol", "y", "x"]).withColumn("_p", F.greatest(F.lit(0.0), F.least(pos, F.col("_last").cast("double"))))
    lo, hi = F.floor("_p"), F.least(F.floor("_p") + 1, F.col("_last"))
    j = j.withColumns({"_lo": lo, "_hi": hi})
    for n in ("_lo", "_hi"):
        j = j.join(blocks.select("vol", "y", "x", F.col("_b").alias(n), F.col("_a").alias(f"{n}v")), ["vol", "y", "x", n])
    t = F.col("_p") - F.col("_lo")
    j = j.withColumn("_y", F.col("_lov") * (1 - t) + F.col("_hiv") * t)
    return j.drop("_lo", "_hi", "_lov", "_hiv", "_p", "_last").withColumnRenamed("_y", "out")


def gamma(d: DataFrame, seed: int, lo: float = 0.7, hi: float = 1.5, p: float = 0.5) -> DataFrame:
    return d.withColumn("g", F.when(rng.gate(p, seed, "gg", "vol"), F.pow("v", rng.log_uniform(lo, hi, seed, "gamma", "vol"))).otherwise(F.col("v")))


def add_noise(d: DataFrame, seed: int, sd: float) -> DataFrame:
    return d.withColumn("g", clamp01(F.col("v") + rng.uniform(seed, "sd", "vol") * sd * rng.normal(seed, "an", "vol", "i")))


#: Perturbers of a guidance map v, by name; each returns it in g.
PERTURBERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "identity": lambda d, seed: d.withColumn("g", F.col("v")),
    "procedural_noise": lambda d, seed: fractal_noise(d, seed).withColumn("g", F.when(foreground(), clamp01(F.col("v") + 0.2 * F.col("noise"))).otherwise(0.0)).drop("noise"),
    "bezier": lambda d, seed: d.withColumn("g", F.when(foreground(), bezier(F.col("v"), seed, 1.0)).otherwise(0.0)),
    "heavy_gaussian": lambda d, seed: Wn.blur(d, 3.0, 10, "replicate").withColumn("g", F.col("v")),
    "mild_gaussian": lambda d, seed: Wn.blur(d, 1.0, 4, "replicate").withColumn("g", F.col("v")),
}

#: Numbers of chunks that generators draw from.
CHUNKS = [2, 3, 4, 6, 8, 12, 16]

#: Generators by name; each maps (volume rows, seed) to rows with the guidance in g.
GENERATORS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "legacy": lambda d, seed: chunk_swap(d, 8, seed),
    "v17": lambda d, seed: rbf_targets(d, seed, histogram_peaks(d)),
    "v19": lambda d, seed: label_texture(d, seed),
    "v23": lambda d, seed: chunk_levels(d, CHUNKS, seed, even=True),
    "v24": lambda d, seed: chunk_levels(d, CHUNKS, seed, dark=0.02),
    "v24_nm": lambda d, seed: knot_map(d, seed, False),
    "v24_nm2": lambda d, seed: knot_map(d, seed, True),
    "v24_t2w": lambda d, seed: chunk_levels(d, [3], seed, levels=[(0.6, 1.0), (0.2, 0.8), (0.0, 0.4)], dark=0.02),
    "v24_pdw": lambda d, seed: chunk_levels(d, [3], seed, levels=[(0.02, 0.08), (0.55, 0.65), (0.40, 0.50)], alpha=(1.2, 1.8), dark=0.02),
    "v24_desc": lambda d, seed: chunk_levels(d, [2, 3, 4], seed, falling=True, dark=0.02),
    "v24_inv": lambda d, seed: chunk_levels(d, CHUNKS, seed, dark=0.02).withColumn("g", F.when(foreground(0.02), F.when(rng.uniform(seed, "inv", "vol") > 0.5, clamp01(1 - F.col("v"))).otherwise(F.col("g"))).otherwise(0.0)),
    "v25": lambda d, seed: ellipsoids(d, seed, CHUNKS),
    "synthseg": lambda d, seed: synthseg_labels(d, seed),
    "v27a": lambda d, seed: label_chunks(d, seed),
    "v27a_bis": lambda d, seed: minmax(label_affine(parcellation_remap(d, "v26_4", seed).withColumnRenamed("g", "c"), seed, "c", 0.5, 100, sign=False).drop("c")),
    **{name: (lambda d, seed, n=name: parcellation_remap(d, n, seed)) for name in VERSIONS},
}


def generate(d: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """The guidance g of a generator by name; an unknown name falls back to the legacy one."""
    return GENERATORS.get(name, GENERATORS["legacy"])(d, seed)


def _drawn_blur(d: DataFrame, seed: int, tag: str, sigmas: tuple[float, ...], together: bool) -> DataFrame:
    """g blurred by a width drawn per volume, or by one for all volumes together."""
    sigma = rng.choice(list(sigmas), seed, tag, *([] if together else ["vol"]))
    out = None
    for s in sigmas:  # a volume is in one branch only
        part = d.where(sigma == s)
        part = Wn.blur(part, s, value="g").select(*d.columns) if s else part
        out = part if out is None else out.unionByName(part)
    return out


def synthesise(d: DataFrame, seed: int = 42, sigmas: tuple[float, ...] = (0.0, 0.5, 1.0), dark: float = DARK, together: bool = False) -> DataFrame:
    """Volume synthesis: signed remap of cells, clamp, a drawn blur (one for the whole batch with together); g in [0, 1] and zed,
    its z-score in the foreground."""
    o = parcellation_remap(d, "raw", seed, dark).withColumn("g", F.when(foreground(dark), clamp01(F.col("g"))).otherwise(0.0))
    out = _drawn_blur(o, seed, "sigma", sigmas, together)
    return zscore_foreground(materialize(out.withColumn("zed", F.col("g")), "synthesised"), "zed", dark)


def synthesise_patches(d: DataFrame, centres: DataFrame, seed: int = 42, sigmas: tuple[float, ...] = (0.0, 0.5, 1.0), dark: float = DARK) -> DataFrame:
    """The same for patches (rows keyed by vol) with the clusters of their whole volumes (centres: vol, c, centroids), inside the
    segmentation: label over 0 is what is remapped and scored; dark voxels become 0."""
    inside = F.col("label") > 0
    masked = d.withColumn("_v", F.col("v")).withColumn("v", F.when(inside, F.greatest(F.col("v"), F.lit(dark * (1 + 1e-9)))).otherwise(0.0))
    o = VERSIONS["raw"]
    j = _remapped(_regions(masked, o, seed, dark, centres), o, seed, dark)
    j = _drawn_blur(j.withColumn("g", F.when(inside, clamp01(F.col("g"))).otherwise(0.0)).withColumn("v", F.col("_v")), seed, "sigma", sigmas, False)
    j = materialize(j.withColumn("g", F.when(F.col("v") < dark, 0.0).otherwise(F.col("g"))), "patches")
    return zscore_in(j, inside, "g", "zed").drop("_v")


def zscore_in(d: DataFrame, inside: Column, value: str, name: str, eps: float = 1e-7, sample: bool = False) -> DataFrame:
    """name: z-scores of value where inside holds, 0 elsewhere. The population's deviation has eps under the root, the sample's beside it."""
    x = F.when(inside, F.col(value))
    s = d.groupBy("vol").agg(F.avg(x).alias("_m"), (F.stddev_samp(x) + eps if sample else F.sqrt(F.var_pop(x) + eps)).alias("_s"))
    return d.join(s, "vol").withColumn(name, F.when(inside, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def synthesise_in_labels(d: DataFrame, seed: int = 42, sigmas: tuple[float, ...] = (0.0, 0.5, 1.0), dark: float = DARK) -> DataFrame:
    """A generated volume blurred, clamped and scored inside the labels by the sample's deviation."""
    j = _drawn_blur(parcellation_remap(d, "v26_6", seed, dark), seed, "sigma", sigmas, False)
    j = materialize(j.withColumn("g", F.when(F.col("v") < dark, 0.0).otherwise(clamp01(F.col("g")))), "labelled")
    return zscore_in(j, F.col("label") > 0, "g", "zed", sample=True)


def synthesise_labels(d: DataFrame, seed: int = 42, sigmas: tuple[float, ...] = (0.0, 0.5, 1.0), dark: float = DARK) -> DataFrame:
    """Batch synthesis, then a signed affine remap per label of at least four voxels with probability one half, and a second drawn blur."""
    o = synthesise(d, seed, sigmas, dark, together=True).drop("zed").withColumnRenamed("g", "first")
    o = label_affine(o, seed + 1, "first", 0.5, 4, dark, mask=F.lit(True)).drop("first")
    o = materialize(_drawn_blur(o, seed + 1, "sigma", sigmas, True), "labelled")
    return zscore_foreground(o.withColumn("zed", F.col("g")), "zed", dark)


def blur_mm(d: DataFrame, sigma: float, spacing: dict[str, float]) -> DataFrame:
    """Gaussian blur by a width in millimetres: in voxels, the width over each axis's spacing; end values are held."""
    for a in Wn.AXES:
        s = sigma / spacing[a]
        d = Wn.filter_lines(d, Wn.gaussian(max(1, int(3 * s + 0.5)), s), "replicate", "v", (a,))
    return d
