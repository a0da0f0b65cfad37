"""Samples, splits and their checks. Every choice is a hash order, so it does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.functions.rng import hash_order
from scanframe.operators.discovery import position
from scanframe.session import materialize


def isolation(test_subject: Column, test_scanner: Column) -> Column:
    """test: both; trainval: neither; discarded: the scanner only; none: the subject only."""
    return F.when(test_subject & test_scanner, "test").when(~test_subject & ~test_scanner, "trainval").when(test_scanner, "discarded").otherwise("none")


def hash_sample(d: DataFrame, by: list[str], n: int | Column, seed: int, tag: str, *ids: str) -> DataFrame:
    """n rows of each group in hash order; all of a smaller group."""
    w = W.partitionBy(*by).orderBy(hash_order(seed, tag, *ids), *ids)
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def stratified(d: DataFrame, group: str, stratum: str, n_max: int, seed: int, *ids: str) -> DataFrame:
    """Groups over n_max keep max(1, round(share * n_max)) of each stratum (half to even), limited by the stratum and by what is
    left of n_max when strata are served by falling size; smaller groups keep everything."""
    c = d.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(W.partitionBy(group))
    want = F.least(F.greatest(F.lit(1).cast("double"), F.bround(F.col("c") / total * n_max)), F.col("c").cast("double")).cast("long")
    c = c.withColumns({"total": total, "want": want})
    order = W.partitionBy(group).orderBy(F.desc("c"), stratum)
    before = F.coalesce(F.sum("want").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = F.when(F.col("total") <= n_max, F.col("c")).otherwise(F.greatest(F.lit(0), F.least("want", F.lit(n_max) - before)))
    alloc = c.withColumn("take", take).select(F.col(group).alias("_g"), F.col(stratum).alias("_s"), "take")
    j = d.join(alloc, (F.col(group) == F.col("_g")) & (F.col(stratum) == F.col("_s")))
    w = W.partitionBy(group, stratum).orderBy(hash_order(seed, "strata", *ids), *ids)
    return j.withColumn("_n", F.row_number().over(w)).where("_n <= take").drop("_n", "_g", "_s", "take")


def _placed(subjects: DataFrame, col: str, seed: int, tag: str) -> tuple[DataFrame, int]:
    """Distinct subjects with their 0-based place _at in hash order, and their number."""
    s = materialize(subjects.select(col).distinct().withColumn("_h", hash_order(seed, tag, col)), "subjects")
    return position(s, ["_h"], "_at"), s.count()


def split_ratio(subjects: DataFrame, col: str, train: float, val: float, seed: int) -> DataFrame:
    """part of each distinct subject: max(1, floor(n * ratio)) for train and val in hash order, the rest test."""
    s, n = _placed(subjects, col, seed, "split")
    a = max(1, int(n * train))
    b = a + max(1, int(n * val))
    return s.select(col, F.when(F.col("_at") < a, "train").when(F.col("_at") < b, "val").otherwise("test").alias("part"))


def k_folds(subjects: DataFrame, col: str, k: int, seed: int) -> DataFrame:
    """fold (from 0) of each distinct subject: contiguous runs of the hash order, the first ones longer by the remainder."""
    s, n = _placed(subjects, col, seed, "fold")
    size, longer = n // k, n % k
    at = F.col("_at")
    fold = F.when(at < longer * (size + 1), F.floor(at / (size + 1))).otherwise(longer + F.floor((at - longer * (size + 1)) / max(1, size)))
    return s.select(col, fold.cast("int").alias("fold"))


def fold_errors(folds: DataFrame, col: str, test: DataFrame, k: int) -> DataFrame:
    """One row per broken rule (rule, n): overlap of train and val in a fold, test subjects in folds, fold numbers out of range."""
    overlap = folds.groupBy("fold", col).agg(F.count_distinct("part").alias("n")).where("n > 1")
    leaked = folds.join(test.select(col).distinct(), col, "left_semi").select(col).distinct()
    wrong = folds.where((F.col("fold") < 0) | (F.col("fold") >= k)).select("fold").distinct()
    count = lambda d, name: d.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"))
    return count(overlap, "overlap").unionByName(count(leaked, "contaminated")).unionByName(count(wrong, "fold out of range"))


def check_folds(folds: DataFrame, col: str, test: DataFrame, k: int) -> None:
    """Raises ValueError on the first broken rule."""
    for r in fold_errors(folds, col, test, k).where("n > 0").collect():
        raise ValueError(f"{r['rule']}: {r['n']}")


def stride(d: DataFrame, index: str, total: Column, n_max: int) -> DataFrame:
    """Every s-th row so that at most about n_max are used."""
    step = F.greatest(F.lit(1), F.floor(total / n_max)).cast("int")
    return d.where(F.pmod(F.col(index), step) == 0)


def adaptive_step(total: Column, target: float = 250_000.0) -> Column:
    """max(1, round((n / target) ** (1 / 3))), half to even."""
    return F.greatest(F.lit(1), F.bround(F.pow(total / target, F.lit(1 / 3))).cast("int"))
