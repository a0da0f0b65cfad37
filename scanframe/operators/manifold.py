"""Statistics of real and generated populations in a vector space: rows (vec_id, cohort, modality, scanner, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.operators.neighbors import knn, within
from scanframe.session import materialize

FRACTIONS = (0.25, 0.5, 1.0, 2.0, 4.0)
MIN_REAL, MIN_IND, MAX_K = 4, 5, 3


def zscored(d: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec: the vector, each element less its mean over its population deviation. The statistics are one row."""
    e = d.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    one = e.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("_st"))
    z = F.transform(vector, lambda x, i: F.coalesce((x.cast("double") - F.get("_st", i)["m"]) / F.nullif(F.get("_st", i)["s"], F.lit(0.0)), F.lit(0.0)))
    return d.join(F.broadcast(one)).withColumn("vec", z).drop("_st")  # one row of as many triples as the vector has elements


def split(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return d.where("cohort = 'real'"), d.where("cohort = 'synth'")


def coverage(d: DataFrame) -> DataFrame:
    """Per modality and for all: how far generated vectors reach the real ones, at multiples of the real sampling distance."""
    real, synth = split(d)
    to_synth = knn(real, synth, "vec_id", "vec", 1).select(F.col("q").alias("vec_id"), "dist")
    to_real = knn(synth, real, "vec_id", "vec", 1).select("dist")
    scale = knn(real, real, "vec_id", "vec", 1, exclude_self=True).agg(F.percentile("dist", 0.5).alias("ref"))
    spread = knn(synth, synth, "vec_id", "vec", 1, exclude_self=True).agg(F.avg("dist").alias("self"), F.count(F.lit(1)).alias("n_synthetic"))
    name = lambda kind, f: f"{kind}_{f:.2f}x_scale"
    j = real.select("vec_id", "modality").join(to_synth, "vec_id").join(F.broadcast(scale))
    both = j.withColumn("modality", F.explode(F.array("modality", F.lit("all"))))
    n = F.count(F.lit(1)).over(W.partitionBy("modality"))
    r = F.row_number().over(W.partitionBy("modality").orderBy("dist"))
    both = both.withColumns({"_n": n, "_r": r})
    half = F.floor(F.col("_n") * 0.5)  # sorted[int(.5 n) - 1]: for n = 1 that is the last one
    most = F.least(F.floor(F.col("_n") * 0.9), F.col("_n") - 1) + 1
    per = both.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_original"), F.first("ref").alias("ref_scale"), F.avg("dist").alias("mean_nn"), F.percentile("dist", 0.5).alias("median_nn"), F.percentile("dist", 0.9).alias("p90_nn"),
        F.max(F.when(F.col("_r") == F.when(half == 0, F.col("_n")).otherwise(half), F.col("dist"))).alias("eps_50"), F.max(F.when(F.col("_r") == most, F.col("dist"))).alias("eps_90"),
        *[F.avg((F.col("dist") <= F.col("ref") * f).cast("double")).alias(name("recall", f)) for f in FRACTIONS],
    )
    precision = to_real.join(F.broadcast(scale)).agg(*[F.avg((F.col("dist") <= F.col("ref") * f).cast("double")).alias(name("precision", f)) for f in FRACTIONS])
    out = per.join(F.broadcast(precision)).join(F.broadcast(spread))
    return out.withColumn("spread_ratio", F.col("self") / F.greatest("ref_scale", F.lit(1e-9))).withColumnRenamed("self", "diversity")


def cluster_coverage(d: DataFrame, scale: float | Column, by: list[str]) -> DataFrame:
    real, synth = split(d)
    dist = knn(real, synth, "vec_id", "vec", 1).select(F.col("q").alias("vec_id"), "dist")
    s = F.lit(scale) if isinstance(scale, float) else scale
    return real.select("vec_id", *by).join(dist, "vec_id").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_original"), F.avg("dist").alias("mean_nn"), (F.avg("dist") / F.greatest(s, F.lit(1e-9))).alias("mean_scaled"),
        *[F.avg((F.col("dist") <= s * f).cast("double")).alias(f"recall_{f:.2f}x") for f in FRACTIONS],
    )


def recall_curve(distances: DataFrame, by: list[str], steps: int) -> DataFrame:
    """Share of distances within each of so many radii up to the group's 99th percentile."""
    top = distances.groupBy(*by).agg(F.percentile("dist", 0.99).alias("_top"))
    each = distances.join(top, by).select(*by, "dist", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct(k.alias("step"), (F.col("_top") * k / (steps - 1)).alias("eps")))).alias("e"))
    return each.groupBy(*by, F.col("e.step").alias("step")).agg(F.first("e.eps").alias("eps"), F.avg((F.col("dist") <= F.col("e.eps")).cast("double")).alias("recall"))


def self_distances(real: DataFrame, by: list[str]) -> DataFrame:
    """Median and 95th percentile of nearest-neighbour distances inside each group; 1 and 1 for a single row."""
    near = knn(real, real, "vec_id", "vec", 1, by, exclude_self=True).groupBy(*by).agg(F.percentile("dist", 0.5).alias("median_nn"), F.percentile("dist", 0.95).alias("p95_nn"))
    return real.groupBy(*by).agg(F.count(F.lit(1)).alias("n_real")).join(near, by, "left").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("median_nn", "p95_nn")})


def against_groups(d: DataFrame, by: list[str]) -> DataFrame:
    """Every generated row against every group of real rows: distance to the group, ind, normalised distance."""
    real, synth = split(d)
    groups = self_distances(real, by)
    near = knn(synth, real, "vec_id", "vec", 1, by, across=True).select(*by, F.col("q").alias("vec_id"), "dist")
    return near.join(groups, by).withColumns({"ind": F.col("dist") <= F.col("p95_nn"), "norm": F.col("dist") / F.greatest("median_nn", F.lit(1e-8))})


def prdc(d: DataFrame, by: list[str]) -> DataFrame:
    """Per group: counts, precision, recall, density and coverage of the generated rows that are in distribution."""
    d = materialize(d.select("vec_id", "cohort", "vec", *by), "vectors")
    real, synth = split(d)
    a = materialize(against_groups(d, by), "against")  # read by what follows several times
    counts = a.groupBy(*by).agg(
        F.first("n_real").alias("n_real"), F.first("median_nn").alias("median_nn"), F.first("p95_nn").alias("p95_nn"), F.count_if("ind").alias("n_ind"), F.count_if(~F.col("ind")).alias("n_ood"),
        F.avg(F.when(~F.col("ind"), F.col("norm"))).alias("ood_mean"), F.var_pop(F.when(~F.col("ind"), F.col("norm"))).alias("ood_var"),
    )
    counts = materialize(counts.withColumn("k", F.when(F.col("n_ind") > 1, F.least(F.lit(MAX_K), F.col("n_real") - 1, F.col("n_ind") - 2)).otherwise(0)), "counts")
    usable = counts.where((F.col("n_real") >= MIN_REAL) & (F.col("n_ind") >= MIN_IND) & (F.col("k") >= 1)).select(*by, "k", "n_ind")
    fake = materialize(a.where("ind").select(*by, "vec_id").join(synth.select("vec_id", "vec"), "vec_id").join(usable, by), "fake")
    r = materialize(real.join(usable, by), "real")

    def radius(x: DataFrame) -> DataFrame:
        near = knn(x, x, "vec_id", "vec", MAX_K, by, exclude_self=True).join(usable, by).where(F.col("rank") == F.col("k"))
        return x.select(*by, "vec_id", "vec").join(near.select(*by, F.col("q").alias("vec_id"), F.col("dist").alias("radius")), [*by, "vec_id"])

    rr, fr = materialize(radius(r), "radii"), materialize(radius(fake), "radii")
    inside = within(fake, rr, "vec_id", "vec", "radius", by).groupBy(*by).agg(F.avg((F.col("inside") > 0).cast("double")).alias("precision"), F.avg("inside").alias("_dense"))
    recall = within(r, fr, "vec_id", "vec", "radius", by).groupBy(*by).agg(F.avg((F.col("inside") > 0).cast("double")).alias("recall"))
    near = knn(r, fake, "vec_id", "vec", 1, by).select(*by, F.col("q").alias("vec_id"), "dist")
    cover = rr.join(near, [*by, "vec_id"]).groupBy(*by).agg(F.avg((F.col("dist") < F.col("radius")).cast("double")).alias("coverage"))
    out = counts.join(inside, by, "left").join(recall, by, "left").join(cover, by, "left")
    return out.withColumn("density", F.col("_dense") / F.col("k")).drop("_dense")


def centroids(d: DataFrame, by: list[str]) -> DataFrame:
    """by, c (a number for the group) and vec: the mean vector of each group."""
    c = d.select(*by, F.posexplode("vec").alias("dim", "v")).groupBy(*by, "dim").agg(F.avg("v").alias("v"))
    c = c.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("vec"))
    return c.select(*by, F.xxhash64(*by).alias("c"), "vec")


def nearest_centroid(d: DataFrame, label: str) -> DataFrame:
    """vec_id, nearest and dist: centroids are the base of a neighbour search in blocks."""
    c = materialize(centroids(d, [label]), "centroids")
    near = knn(d.select(F.col("vec_id").alias("c"), "vec"), c.select("c", "vec"), "c", "vec", 1)
    return near.join(c.select(F.col("c").alias("b"), F.col(label).alias("nearest")), "b").select(F.col("q").alias("vec_id"), "nearest", "dist")


def nearest_to_centroids(d: DataFrame, candidates: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, vec_id, dist, rank: the k candidates nearest to each group's centroid."""
    c = materialize(centroids(d, by), "centroids")
    near = knn(c.select("c", "vec"), candidates.select(F.col("vec_id").alias("c"), "vec"), "c", "vec", k)
    return near.join(c.select(F.col("c").alias("q"), *by), "q").select(*by, F.col("b").alias("vec_id"), "dist", "rank")


def outliers(d: DataFrame, limit: float) -> DataFrame:
    """vec_id, max_z, kept: the greatest absolute z-score over a row's elements against the limit."""
    z = zscored(d, "vec_raw")
    return z.select("vec_id", F.array_max(F.transform("vec", lambda x: F.abs(x))).alias("max_z")).withColumn("kept", F.col("max_z") <= limit)


def symmetric(edges: DataFrame) -> DataFrame:
    """(G + G') / 2 of directed edges (src, dst, w): both directions of every pair."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
