"""Operators on wide and long feature tables and on score rows.

Long form is (row id, dim, v): one row per feature value, null where missing. Wide vectors are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Endings of features in intensity units and in squared units.
INTENSITY = ("10Percentile", "90Percentile", "Maximum", "Mean", "MeanAbsoluteDeviation", "Median", "Minimum", "Range", "RobustMeanAbsoluteDeviation", "RootMeanSquared", "InterquartileRange")
INTENSITY_SQUARED = ("Variance", "Energy", "TotalEnergy")
RENAMES = {"modality_id": "modality", "scanner_model": "scanner", "scanner_vendor": "vendor", "cohort_category": "cohort"}


def harmonise(d: DataFrame) -> DataFrame:
    """Synonymous columns renamed where the target is missing; columns that are missing altogether are 'unknown'."""
    for old, new in RENAMES.items():
        if old in d.columns and new not in d.columns:
            d = d.withColumnRenamed(old, new)
        elif new not in d.columns:
            d = d.withColumn(new, F.lit("unknown"))
    return d


def explode_features(d: DataFrame, vector: str = "embedding") -> DataFrame:
    return d.select(*[c for c in d.columns if c != vector], F.posexplode(vector).alias("dim", "v")).withColumn("v", F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double")))


def feature_stats(long: DataFrame, by: str = "dim") -> DataFrame:
    """Per feature: n, mean and population variance over the rows that have it."""
    return long.groupBy(by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def drop_all_missing(long: DataFrame) -> DataFrame:
    return long.join(feature_stats(long).where("n > 0").select("dim"), "dim", "left_semi")


def drop_constant(long: DataFrame) -> DataFrame:
    return long.join(feature_stats(long).where("var > 0").select("dim"), "dim", "left_semi")


def impute(long: DataFrame, fit: Column | None = None) -> DataFrame:
    """Missing values become the feature's mean, over the rows where fit holds if it is given."""
    rows = long if fit is None else long.where(fit)
    means = rows.groupBy("dim").agg(F.avg("v").alias("_mean"))
    return long.join(means, "dim").withColumn("v", F.coalesce("v", "_mean")).drop("_mean")


def build_matrix(long: DataFrame, fit: Column | None = None) -> DataFrame:
    """Features with a value and with variance after mean imputation: what is left of dropping, imputing and dropping."""
    rows = long if fit is None else long.where(fit)
    stats = rows.groupBy("dim").agg(F.avg("v").alias("_mean"), F.var_pop("v").alias("_var"))
    out = long.join(stats.where("_mean IS NOT NULL AND _var > 0"), "dim")  # imputed means add no variance where there was none
    return out.withColumn("v", F.coalesce("v", "_mean")).drop("_mean", "_var")


def zscore(long: DataFrame, by: str = "dim") -> DataFrame:
    """(v - mean) / population deviation per feature; 0 where there is no deviation."""
    s = long.groupBy(by).agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_sd"))
    return long.join(s, by).withColumn("v", F.coalesce((F.col("v") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(0.0))).drop("_mean", "_sd")


def white_matter_ratio(long: DataFrame, id_col: str, name: str, reference: list[str]) -> DataFrame:
    """Intensity features over the row's mean of the reference features, squared ones over its square; others as they are."""
    ref = long.where(F.col(name).isin(reference)).groupBy(id_col).agg(F.avg("v").alias("_ref"))
    ending = F.substring_index(name, "firstorder_", -1)
    first = F.contains(name, F.lit("firstorder_"))
    out = F.when(first & ending.isin(*INTENSITY), F.try_divide("v", "_ref")).when(first & ending.isin(*INTENSITY_SQUARED), F.try_divide("v", F.col("_ref") * F.col("_ref"))).otherwise(F.col("v"))
    return long.join(ref, id_col, "left").withColumn("v", out).drop("_ref")


def mean_of_groups(d: DataFrame, first: list[str], then: list[str], value: str = "value") -> DataFrame:
    """Means over first, then the mean of those means over then."""
    return d.groupBy(*first).agg(F.avg(value).alias("_m")).groupBy(*then).agg(F.avg("_m").alias("mean"))


def pivot_scores(d: DataFrame, index: list[str], cols: dict[str, Column], value: str = "value") -> DataFrame:
    """Wide means: one column per named condition, so that no pass is needed to learn the columns."""
    return d.groupBy(*index).agg(*[F.avg(F.when(c, F.col(value))).alias(k) for k, c in cols.items()])


def domain_scores(means: DataFrame, by: str, contrast: str, source: str, value: str = "mean") -> DataFrame:
    """in_domain, ood_mean and ood_worst of each group."""
    own, other = F.when(F.col(contrast) == source, F.col(value)), F.when(F.col(contrast) != source, F.col(value))
    return means.groupBy(by).agg(F.avg(own).alias("in_domain"), F.avg(other).alias("ood_mean"), F.min(other).alias("ood_worst"))


def top_k(d: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return d.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def one_way_f(long: DataFrame, group: str, feature: str = "dim") -> DataFrame:
    """One-way ANOVA per feature from sums alone: F, with its degrees of freedom."""
    g = long.where("v IS NOT NULL").groupBy(feature, group).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.groupBy(feature).agg(
        F.sum("n").alias("N"), F.count("n").alias("k"), F.sum(F.col("n") * F.col("m")).alias("sm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum(F.col("n") * F.col("s")).alias("within"),
    )
    between = F.col("sq") - F.col("sm") * F.col("sm") / F.col("N")
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k")))
    return t.select(feature, f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("N") - F.col("k")).alias("df2"))


def cohens_d(long: DataFrame, cohort: str, a: str, b: str, feature: str = "dim") -> DataFrame:
    """(mean of b - mean of a) over the pooled sample deviation; null where that is 0."""
    of = lambda c: F.when(F.col(cohort) == c, F.col("v"))
    s = long.groupBy(feature).agg(*[x.alias(k) for c, p in ((a, "a"), (b, "b")) for k, x in ((f"m{p}", F.avg(of(c))), (f"v{p}", F.var_samp(of(c))), (f"n{p}", F.count(of(c))))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return s.select(feature, ((F.col("mb") - F.col("ma")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def average_ranks(d: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    w = W.partitionBy(*by)
    return d.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2)


def spearman(d: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    r = average_ranks(average_ranks(d, by, x, "_rx"), by, y, "_ry")
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))
