"""Listings of scans, checkpoints and subjects: everything that the file system's names say, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.functions import names as N
from scanframe.session import materialize


def with_entities(paths: DataFrame) -> DataFrame:
    """Adds the map entities, by a generator of one row: filters and tags read the map and never parse the name again."""
    return paths.withColumn("entities", F.explode(F.array(N.bids_entities(N.file_name(F.col("path"))))))


def discover_scans(paths: DataFrame, masks: DataFrame | None, magnitude_only: bool = True, echoes: list[str] | None = None) -> DataFrame:
    """Scans outside derivatives, without deface masks; of GRE only magnitude parts (and the echoes); with a mask if masks are given."""
    d = with_entities(paths.where(~F.contains("path", F.lit("/derivatives/")) & F.endswith("path", F.lit(".nii.gz"))))
    e = F.col("entities")
    suffix = F.coalesce(e["suffix"], F.lit(""))
    keep = suffix != "defacemask"
    if magnitude_only:
        keep = keep & ((suffix != "GRE") | F.startswith(F.coalesce(e["part"], F.lit("")), F.lit("mag")))
    if echoes:
        keep = keep & ((suffix != "GRE") | F.coalesce(e["echo"].isin(echoes), F.lit(False)))
    d = d.where(keep)
    if masks is not None:
        d = d.withColumn("mask_path", F.replace(F.replace("path", F.lit("/data/"), F.lit("/masks/")), F.lit(".nii.gz"), F.lit("_mask.nii.gz")))
        d = d.join(masks.select(F.col("path").alias("mask_path")), "mask_path", "left_semi")
    return d.withColumns({"modality_id": N.modality_id(e), "acq_tag": N.acquisition_tag(e), "sub": F.coalesce(e["sub"], F.lit("?")), "ses": F.coalesce(e["ses"], F.lit("?"))})


def discover_synthetic(paths: DataFrame) -> DataFrame:
    d = with_entities(paths.where(F.col("path").rlike(r"_syn-[^/]*\.nii\.gz$")))
    return d.withColumn("modality_id", F.concat(F.lit("syn-"), F.col("entities")["syn"], F.lit("_run-"), F.col("entities")["run"]))


def discover_t1w(paths: DataFrame) -> DataFrame:
    return paths.where(F.endswith("path", F.lit("_T1w.nii.gz")) & ~F.contains("path", F.lit("/derivatives/")))


def newest(d: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group the value of the greatest order; the greater value on a tie."""
    return d.groupBy(*by).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order))


def first_by_priority(d: DataFrame, by: list[str], variant: str, priority: list[str]) -> DataFrame:
    """Per group the row of the variant that comes first in the priority list; others are left out."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(variant))
    w = W.partitionBy(*by).orderBy("_rank")
    return d.withColumn("_rank", rank).where("_rank > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def shard(d: DataFrame, order: list[str], rank: int, world: int) -> DataFrame:
    """Rows rank, rank + world, ... in the given order (dense positions by range-partitioned counts)."""
    return position(d, order, "_pos").where(F.pmod("_pos", F.lit(world)) == rank).drop("_pos")


def position(d: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based place of each row in a global order, without one task for all rows: rows are range partitioned,
    counted per partition, and numbered from the partition's offset."""
    s = d.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    s = s.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    s = materialize(s, "positions")  # range bounds are sampled; a table keeps one answer
    n = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_before", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).drop("_n")  # a row per partition
    return s.join(F.broadcast(before), "_p").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_k") - 1).drop("_p", "_k", "_before")


def not_done(d: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return d.join(done.select(key), key, "left_anti")


def unmatched_report(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a partner, and those without."""
    return left.join(right, key), left.join(right, key, "left_anti")


def numbered_ids(d: DataFrame, id_col: str, order: str) -> DataFrame:
    """Repeats of an id get _2, _3, ... in order."""
    n = F.row_number().over(W.partitionBy(id_col).orderBy(order))
    return d.withColumn(id_col, F.when(n == 1, F.col(id_col)).otherwise(F.concat_ws("_", F.col(id_col), n.cast("string"))))


def remap_in_order(value: Column, rules: list[tuple[int, int]]) -> Column:
    """Rules applied one after another: a later rule sees what earlier ones made."""
    for old, new in rules:
        value = F.when(value == old, F.lit(new)).otherwise(value)
    return value
