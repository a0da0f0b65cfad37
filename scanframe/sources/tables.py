"""CSV, TSV and JSON documents as DataFrames, with the checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions import names as N
from scanframe.operators.tabular import harmonise


def features_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A feature table with synonymous columns harmonised and NaN as null."""
    d = harmonise(spark.read.csv(path, header=True, schema=schema))
    return d.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in d.dtypes])


def registry_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("model_id", "family", "source_contrast", "checkpoint_path", "enabled")) -> DataFrame:
    """Enabled models; a missing column is an error."""
    d = spark.read.csv(path, header=True)
    if missing := sorted(set(required) - set(d.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return d.withColumn("enabled", N.parse_enabled(F.col("enabled"))).where("enabled")


def inline_models(spark: SparkSession, specs: list[str]) -> DataFrame:
    """id,family,contrast,path texts as rows."""
    rows = [s.split(",") for s in specs]
    if bad := [s for s, r in zip(specs, rows, strict=True) if len(r) != 4]:
        raise ValueError(f"not id,family,contrast,path: {bad[0]}")
    return spark.createDataFrame([tuple(x.strip() for x in r) for r in rows], "model_id string, family string, source_contrast string, checkpoint_path string")


def metrics_json(docs: DataFrame, classes: dict[int, str], metrics: tuple[str, ...] = ("Dice", "HD95")) -> DataFrame:
    """docs: run_id, contrast, json ({metric_per_case: {case: {metric: {class: value}}}}). One row per value of a known class over 0."""
    deep = F.from_json("json", "metric_per_case map<string, map<string, map<string, double>>>")["metric_per_case"]
    d = docs.select("run_id", "contrast", F.explode(deep).alias("case_id", "m")).select("run_id", "contrast", "case_id", F.explode("m").alias("metric", "c"))
    d = d.where(F.col("metric").isin(*metrics)).select("run_id", "contrast", "case_id", "metric", F.explode("c").alias("cls", "value"))
    table = F.create_map(*[x for kv in classes.items() for x in map(F.lit, kv)])
    d = d.withColumn("class", F.expr("try_cast(cls AS int)")).withColumn("class_name", F.try_element_at(table, F.col("class")))
    return d.where("class <> 0 AND class_name IS NOT NULL").withColumn("method", N.method_of_run(F.col("run_id"))).drop("cls")


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """fold, part, subject from either form of a split document: a list of folds or one object of *_subjects."""
    d = spark.read.option("multiLine", True).json(path)
    cols = {p: c for p in ("train", "val", "test") for c in (p, f"{p}_subjects") if c in d.columns}
    d = d.withColumn("fold", F.monotonically_increasing_id()) if "train" in d.columns else d.withColumn("fold", F.lit(0).cast("long"))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).cast("array<string>").alias("subjects")) for p, c in cols.items()])
    return d.select("fold", F.inline(parts)).select("fold", "part", F.explode("subjects").alias("subject"))


def participants_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Case ids without sub-, in order."""
    d = spark.read.csv(path, sep="\t", header=True)
    return d.select(F.regexp_replace("participant_id", "^sub-", "").alias("case_id")).orderBy("case_id")
