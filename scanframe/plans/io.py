"""Queries on sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanframe.plans.catalog import query
from scanframe.session import shared_dir
from scanframe.sources import nifti, sinks, tables
from scanframe.streaming import incremental

r6 = lambda c: F.round(c, 6)


def _place(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/io-{uuid.uuid4().hex}"


@query("src_csv", "feats", "SELECT vec_id, modality, scanner, 'unknown' AS vendor, cohort, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE round(embedding[1]::DOUBLE, 4) END AS f0 FROM {feats}")
def src_csv(feats):
    p = _place(feats.sparkSession)
    value = F.when(F.col("vec_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("embedding")[0].cast("double"), 4))
    sinks.csv(feats.select("vec_id", F.col("modality").alias("modality_id"), F.col("scanner").alias("scanner_model"), F.col("cohort").alias("cohort_category"), value.alias("f0")), p)
    return tables.features_csv(feats.sparkSession, p, "vec_id long, modality_id string, scanner_model string, cohort_category string, f0 double").select("vec_id", "modality", "scanner", "vendor", "cohort", "f0")


@query("src_csv_project", "scans", "SELECT path AS image_path FROM {scans}")
def src_csv_project(scans):
    p = _place(scans.sparkSession)
    sinks.csv(scans.select(F.col("path").alias("image_path"), "sub", "ses"), p)
    return scans.sparkSession.read.csv(p, header=True, schema="image_path string, sub string, ses string").select("image_path")


@query("src_registry_csv", "orders", "SELECT 'm' || o_orderkey AS model_id, 'c' || (o_custkey % 3) AS source_contrast FROM orders WHERE o_orderkey % 3 <> 1")
def src_registry_csv(orders):
    p = _place(orders.sparkSession)
    d = orders.select(F.concat(F.lit("m"), "o_orderkey").alias("model_id"), F.lit("segmenter").alias("family"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("source_contrast"), F.lit("/ck/x").alias("checkpoint_path"), F.when(F.col("o_orderkey") % 3 == 0, "Yes").when(F.col("o_orderkey") % 3 == 1, "no").alias("enabled"))
    sinks.csv(d, p)
    return tables.registry_csv(orders.sparkSession, p).select("model_id", "source_contrast")


@query("src_inline", "region", "SELECT unnest(['a', 'b']) AS model_id, unnest(['t1w', 't2w']) AS source_contrast")
def src_inline(region):
    return tables.inline_models(region.sparkSession, ["a,segmenter,t1w,/x", "b, v8, t2w, /y"]).select("model_id", "source_contrast")


@query("src_json_nested", "events", "SELECT 'v26_6_r' || (user_id % 5) AS run_id, 'case' || event_id AS case_id, 'Dice' AS metric, (user_id % 4)::INT AS class, 'v26' AS method, value FROM events WHERE user_id % 4 IN (1, 2)")
def src_json_nested(events):
    leaf = F.create_map((F.col("user_id") % 4).cast("string"), F.col("value"), F.lit("mean"), F.lit(0.5))
    case = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("case"), "event_id"), F.create_map(F.lit("Dice"), leaf, F.lit("Recall"), leaf))))
    docs = events.groupBy((F.col("user_id") % 5).alias("r"), (F.col("event_id") % 64).alias("part")).agg(F.to_json(F.struct(case.alias("metric_per_case"))).alias("json"))
    docs = docs.select(F.concat(F.lit("v26_6_r"), "r").alias("run_id"), F.lit("t1w").alias("contrast"), "json")
    return tables.metrics_json(docs, {1: "liver", 2: "spleen"}).select("run_id", "case_id", "metric", "class", "method", "value")


@query("src_json_split", "customer", "SELECT 'train' AS part, 'S' || c_custkey AS subject FROM customer WHERE c_custkey % 5 < 3 UNION ALL SELECT 'val', 'S' || c_custkey FROM customer WHERE c_custkey % 5 = 3 UNION ALL SELECT 'test', 'S' || c_custkey FROM customer WHERE c_custkey % 5 = 4")
def src_json_split(customer):
    p = _place(customer.sparkSession)
    who = F.concat(F.lit("S"), "c_custkey")
    of = lambda c: F.collect_list(F.when(c, who))
    k = F.col("c_custkey") % 5
    sinks.json(customer.agg(F.lit(42).alias("seed"), of(k < 3).alias("train_subjects"), of(k == 3).alias("val_subjects"), of(k == 4).alias("test_subjects")), p)
    return tables.split_json(customer.sparkSession, p).select("part", "subject")


@query("src_tsv", "customer", "SELECT 'S' || c_custkey AS case_id FROM customer")
def src_tsv(customer):
    p = _place(customer.sparkSession)
    customer.select(F.concat(F.lit("sub-S"), "c_custkey").alias("participant_id"), "c_acctbal").write.option("header", True).csv(p, sep="\t")
    return tables.participants_tsv(customer.sparkSession, p)


@query("sink_csv", "region", "SELECT r_regionkey, r_name FROM region")
def sink_csv(region):
    p = _place(region.sparkSession)
    sinks.csv(region.select("r_regionkey", "r_name"), p)
    return region.sparkSession.read.csv(p, header=True, schema="r_regionkey int, r_name string")


@query("sink_csv_append", "nation", "SELECT n_nationkey, n_name FROM nation")
def sink_csv_append(nation):
    p = _place(nation.sparkSession)
    for k in range(2):
        sinks.csv(nation.where(f"n_nationkey % 2 = {k}").select("n_nationkey", "n_name"), p, append=True)
    return nation.sparkSession.read.csv(p, header=True, schema="n_nationkey int, n_name string")


@query("sink_shard_merge", "nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS n_name FROM nation")
def sink_shard_merge(nation):
    return sinks.merge_shards([nation.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), nation.where("n_nationkey % 2 = 1").select("n_nationkey")])


@query("sink_qc_merge", "scans", "SELECT count(*) AS n, count(*) FILTER (WHERE id % 7 = 0) AS flagged FROM {scans}")
def sink_qc_merge(scans):
    shards = [scans.where(f"id % 3 = {k}").select("id", (F.col("id") % 7 == 0).alias("flagged")) for k in range(3)]
    return sinks.merge_shards(shards).agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


@query("sink_json", "region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def sink_json(region):
    p = _place(region.sparkSession)
    sinks.json(region.select("r_regionkey", "r_name"), p)
    return region.sparkSession.read.schema("r_regionkey long, r_name string").json(p)


@query("sink_wide", "evals", "SELECT run_id, round(avg(value) FILTER (WHERE class = 1), 6) AS c1, round(avg(value) FILTER (WHERE class = 2), 6) AS c2, round(avg(value) FILTER (WHERE class = 3), 6) AS c3 FROM {evals} GROUP BY run_id")
def sink_wide(evals):
    long = evals.groupBy("run_id", F.concat(F.lit("c"), "class").alias("k")).agg(r6(F.avg("value")).alias("v"))
    return sinks.wide(long, ["run_id"], "k", "v", ["c1", "c2", "c3"])


@query("sink_long", "evals", "SELECT run_id, 'c' || class AS metric, round(avg(value), 6) AS value FROM {evals} GROUP BY run_id, class")
def sink_long(evals):
    p = _place(evals.sparkSession)
    wide = sinks.wide(evals.groupBy("run_id", F.concat(F.lit("c"), "class").alias("k")).agg(F.avg("value").alias("v")), ["run_id"], "k", "v", ["c1", "c2", "c3"])
    sinks.csv(sinks.long(wide, ["run_id"]), p)
    return evals.sparkSession.read.csv(p, header=True, schema="run_id string, metric string, value double").withColumn("value", r6("value"))


@query("sink_md", "region", "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS md FROM region")
def sink_md(region):
    return region.sparkSession.createDataFrame([(sinks.markdown(region.select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "md string")


@query("sink_ascii", "region", "SELECT count(*) + 1 AS lines FROM region")
def sink_ascii(region):
    return region.sparkSession.createDataFrame([(len(sinks.aligned(region).split("\n")),)], "lines long")


@query("sink_route", "evals", "SELECT run_id, contrast, count(*) AS n FROM {evals} GROUP BY ALL")
def sink_route(evals):
    p = _place(evals.sparkSession)
    sinks.route(evals, p, ["run_id", "contrast"])
    return evals.sparkSession.read.parquet(p).groupBy("run_id", "contrast").agg(F.count(F.lit(1)).alias("n"))


@query("sink_nnunet", "scans", "SELECT id AS case_id, 'D1/imagesTr/' || id || '_0000.nii.gz' AS image, 'D1/labelsTr/' || id || '.nii.gz' AS label FROM {scans}")
def sink_nnunet(scans):
    return sinks.export_manifest(scans.select(F.col("id").alias("case_id"), F.lit(0).alias("channel")), "D1")


@query("sink_symlinks", "customer", "SELECT 'root/fold_' || (c_custkey % 4) || '/train/S' || c_custkey AS link FROM customer")
def sink_symlinks(customer):
    return sinks.link_plan(customer.select((F.col("c_custkey") % 4).alias("fold"), F.lit("train").alias("part"), F.concat(F.lit("S"), "c_custkey").alias("subject")), "root").select("link")


@query("src_nifti", "vox", "SELECT vol, 11 * 11 * (max(z) + 1) AS n, round(sum(v::FLOAT::DOUBLE), 4) AS total FROM {vox} GROUP BY vol")
def src_nifti(vox):
    spark = vox.sparkSession
    p = _place(spark)
    packed = vox.groupBy("vol").agg(F.max("z").alias("mz"), F.collect_list(F.struct("i", "v")).alias("r"))
    m = F.map_from_entries("r")
    size = (F.col("mz") + 1) * 121
    packed = packed.select("vol", F.array(F.col("mz") + 1, F.lit(11), F.lit(11)).alias("shape"), F.array(*[F.lit(float(i == j)) for i in range(4) for j in range(4)]).alias("affine"), F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast("float")).alias("data"))
    if not sinks.nifti_files(packed, p).agg(F.sum("bytes")).first()[0]:
        return spark.createDataFrame([], "vol int, n int, total double")
    d = nifti.read(spark, p)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return d.select(F.regexp_extract("path", r"vol-(\d+)", 1).cast("int").alias("vol"), F.size("data").alias("n"), F.round(total, 4).alias("total"))


@query("stream_extract", "events", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_extract(events):
    """New files only, each row once: two deliveries of overlapping files through the stream."""
    spark = events.sparkSession
    p = _place(spark)
    events.where("event_id % 2 = 0").write.parquet(f"{p}/in")
    run = lambda: incremental.extract(spark, f"{p}/in", events.schema, f"{p}/out", f"{p}/ck", lambda d: d.select("event_id", "user_id"), "event_id")
    run()
    events.where("event_id % 4 <> 2").write.mode("append").parquet(f"{p}/in")
    run()
    return spark.read.parquet(f"{p}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
