"""Queries over scan listings: sources, discovery, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.functions import names as N
from scanframe.operators import discovery as D
from scanframe.plans.catalog import query

_ENT = "regexp_extract({0}, '(?:^|_){1}-([^_]*)', 1)"
_HAS = "regexp_matches(name, '(^|_){0}-')"


def _tags(order: tuple[str, ...]) -> str:
    return "concat_ws('_', " + ", ".join(f"CASE WHEN {_HAS.format(k)} THEN '{k}-' || {_ENT.format('name', k)} END" for k in order) + ")"


@query("bids_entities", "scans", "SELECT id, split_part(name, '_', 1)[5:] AS sub, split_part(name, '_', 2)[5:] AS ses, suffix, nullif(" + _ENT.format("name", "echo") + ", '') AS echo, nullif(" + _ENT.format("name", "task") + ", '') AS task FROM {scans}")
def bids_entities(scans):
    e = F.col("entities")
    return D.with_entities(scans).select("id", e["sub"].alias("sub"), e["ses"].alias("ses"), e["suffix"].alias("suffix"), e["echo"].alias("echo"), e["task"].alias("task"))


@query("modality_id", "scans", f"SELECT id, concat_ws('_', suffix, nullif({_tags(N.MODALITY_TAGS)}, '')) AS modality_id FROM {{scans}}")
def modality_id(scans):
    return D.with_entities(scans).select("id", N.modality_id(F.col("entities")).alias("modality_id"))


@query("acq_tag", "scans", f"SELECT id, {_tags(N.ACQUISITION_TAGS)} AS acq_tag FROM {{scans}}")
def acq_tag(scans):
    return D.with_entities(scans).select("id", N.acquisition_tag(F.col("entities")).alias("acq_tag"))


_SCANNERS = ", ".join(f"('{k}', '{m}', '{v}')" for k, (m, v) in N.SCANNERS.items())


@query("scanner_lookup", "scans", f"SELECT id, coalesce(m, 'Unknown') AS model, coalesce(v, 'Unknown') AS vendor FROM {{scans}} LEFT JOIN (VALUES {_SCANNERS}) t(c, m, v) ON substr(ses, 1, 7) = c")
def scanner_lookup(scans):
    s = N.scanner(F.concat(F.lit("ses-"), "ses"))
    return scans.select("id", s["model"].alias("model"), s["vendor"].alias("vendor"))


@query("scanner_regex", "scans", "SELECT substr(ses, 1, length(ses) - 3) AS scanner, count(*) AS n FROM {scans} GROUP BY 1")
def scanner_regex(scans):
    return scans.select(N.scanner_of_session(F.concat(F.lit("ses-"), "ses")).alias("scanner")).groupBy("scanner").agg(F.count("*").alias("n"))


@query("base_mod", "scans", f"SELECT id, split_part(m, '_', 1) AS base FROM (SELECT id, concat_ws('_', suffix, nullif({_tags(N.MODALITY_TAGS)}, '')) AS m FROM {{scans}})")
def base_mod(scans):
    return D.with_entities(scans).select("id", N.base_modality(N.modality_id(F.col("entities"))).alias("base"))


@query("id_clean", "customer", "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS clean FROM customer")
def id_clean(customer):
    return customer.select("c_custkey", N.alphanumeric(F.col("c_name")).alias("clean"))


@query("normalize_contrast", "scans", "SELECT id, lower(suffix) AS contrast FROM {scans} WHERE suffix IN ('T1w', 'T2w')")
def normalize_contrast(scans):
    raw = F.concat(F.lit("  "), F.regexp_replace("suffix", "w$", ""), F.lit(" "))
    return scans.where(F.col("suffix").isin("T1w", "T2w")).select("id", N.contrast(raw, ["t1w", "t2w"]).alias("contrast"))


_SCAN_FILTER = "path NOT LIKE '%/derivatives/%' AND suffix <> 'defacemask' AND (suffix <> 'GRE' OR name LIKE '%part-mag%')"
_MASKED = "replace(replace(path, '/data/', '/masks/'), '.nii.gz', '_mask.nii.gz') IN (SELECT path FROM {masks})"


@query("disc_scans", "scans masks", f"SELECT id, path, concat_ws('_', suffix, nullif({_tags(N.MODALITY_TAGS)}, '')) AS modality_id, {_tags(N.ACQUISITION_TAGS)} AS acq_tag, sub, ses FROM {{scans}} WHERE {_SCAN_FILTER} AND {_MASKED}")
def disc_scans(scans, masks):
    return D.discover_scans(scans.select("id", "path"), masks).select("id", "path", "modality_id", "acq_tag", "sub", "ses")


@query("disc_scans_echo", "scans", "SELECT id FROM {scans} WHERE " + _SCAN_FILTER + " AND (suffix <> 'GRE' OR name LIKE '%echo-2%')")
def disc_scans_echo(scans):
    return D.discover_scans(scans.select("id", "path"), None, echoes=["2"]).select("id")


@query("disc_synth", "synths", "SELECT id, 'syn-' || (id % 7) || '_run-' || (id % 3) AS modality_id FROM {synths}")
def disc_synth(synths):
    return D.discover_synthetic(synths).select("id", "modality_id")


@query("disc_t1w", "scans", "SELECT id, path FROM {scans} WHERE path LIKE '%\\_T1w.nii.gz' ESCAPE '\\' AND path NOT LIKE '%/derivatives/%'")
def disc_t1w(scans):
    return D.discover_t1w(scans).select("id", "path")


@query("disc_sessions", "scans masks", f"SELECT CAST({_MASKED} AS BOOLEAN) AS has_mask, count(*) AS n FROM {{scans}} WHERE suffix = 'T1w' AND path NOT LIKE '%/derivatives/%' GROUP BY 1")
def disc_sessions(scans, masks):
    t1 = D.discover_t1w(scans).withColumn("mask", F.replace(F.replace("path", F.lit("/data/"), F.lit("/masks/")), F.lit(".nii.gz"), F.lit("_mask.nii.gz")))
    found, missing = D.unmatched_report(t1, masks.select(F.col("path").alias("mask")).distinct(), "mask")
    return found.select(F.lit(True).alias("has_mask")).unionByName(missing.select(F.lit(False).alias("has_mask"))).groupBy("has_mask").agg(F.count("*").alias("n"))


@query("disc_bids", "scans", "SELECT path AS image, sub AS subject FROM {scans} WHERE path NOT LIKE '%/derivatives/%'")
def disc_bids(scans):
    d = D.with_entities(scans.where(~F.contains("path", F.lit("/derivatives/"))))
    return d.select(F.col("path").alias("image"), F.col("entities")["sub"].alias("subject"))


_TASK = "SELECT 'img' || id || '_' || (id % 3) || '_0000.nii.gz' AS image, id % 3 AS c FROM {scans}"


@query("disc_task", "scans", "SELECT 'img' || id || '_1_0000.nii.gz' AS image, 'img' || id || '_1.nii.gz' AS label FROM {scans} WHERE id % 3 = 1 AND id % 4 <> 0")
def disc_task(scans):
    images = scans.select(F.concat(F.lit("img"), "id", F.lit("_"), F.col("id") % 3, F.lit("_0000.nii.gz")).alias("image"))
    labels = scans.where("id % 4 <> 0").select(F.concat(F.lit("img"), "id", F.lit("_"), F.col("id") % 3, F.lit(".nii.gz")).alias("label"))
    wanted = images.where(F.col("image").rlike(r"_1_0000\.nii\.gz$"))
    return wanted.withColumn("label", F.replace("image", F.lit("_0000"), F.lit(""))).join(labels, "label").select("image", "label")


@query("disc_brats", "customer", "SELECT 'BraTS-GLI-' || lpad(CAST(c_custkey AS STRING), 5, '0') || '-' || lpad(CAST(c_custkey % 200 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END, '0') AS dir FROM customer WHERE c_custkey % 3 <> 0")
def disc_brats(customer):
    d = customer.select(F.concat(F.lit("BraTS-GLI-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("-"), F.expr("lpad(CAST(c_custkey % 200 AS STRING), CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END, '0')")).alias("dir"))
    return d.where(F.col("dir").rlike(r"^BraTS-GLI-\d{5}-\d{3}$"))


@query("disc_ckpt", "orders", "SELECT 'fam' || (o_custkey % 5) AS family, 'c' || (o_orderkey % 7) AS contrast, arg_max(path, (mtime, path)) AS path, max(mtime) AS mtime FROM (SELECT *, '/ck/fam' || (o_custkey % 5) || '/c' || (o_orderkey % 7) || '/run' || (o_orderkey % 40) || '/best.ckpt' AS path, o_orderdate AS mtime FROM orders) GROUP BY 1, 2")
def disc_ckpt(orders):
    d = orders.select(F.concat(F.lit("/ck/fam"), F.col("o_custkey") % 5, F.lit("/c"), F.col("o_orderkey") % 7, F.lit("/run"), F.col("o_orderkey") % 40, F.lit("/best.ckpt")).alias("path"), F.col("o_orderdate").alias("mtime"))
    pattern = r"^/ck/(fam\d+)/(c\d+)/"
    d = d.select(F.regexp_extract("path", pattern, 1).alias("family"), F.regexp_extract("path", pattern, 2).alias("contrast"), "path", "mtime")
    return D.newest(d, ["family", "contrast"], "path", "mtime")


@query("disc_latest_run", "orders", "SELECT o_custkey % 20 AS base, max(o_orderkey % 97) AS run, max(CASE WHEN o_orderkey % 97 = m AND o_orderkey % 2 = 0 THEN 'best_loss' || o_orderkey ELSE 'last' END) FILTER (WHERE o_orderkey % 97 = m AND (o_orderkey % 2 = 0 OR NOT any_best)) AS ckpt FROM (SELECT *, bool_or(o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey % 20, o_orderkey % 97) AS any_best, max(o_orderkey % 97) OVER (PARTITION BY o_custkey % 20) AS m FROM orders) GROUP BY 1")
def disc_latest_run(orders):
    d = orders.select((F.col("o_custkey") % 20).alias("base"), F.concat(F.lit("run"), F.col("o_orderkey") % 97).alias("run_dir"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("best_loss"), "o_orderkey")).otherwise("last").alias("ckpt"))
    d = d.withColumn("run", F.regexp_extract("run_dir", r"run(\d+)", 1).cast("long"))
    # the newest run; in it the last best_loss file, else last
    return d.groupBy("base").agg(F.max("run").alias("run"), F.max_by("ckpt", F.struct("run", F.startswith("ckpt", F.lit("best_loss")), "ckpt")).alias("ckpt"))


@query("priority_pick", "scans", "SELECT sub, arg_min(name, (p, name)) AS name FROM (SELECT sub, name, CASE suffix WHEN 'T2w' THEN 1 WHEN 'T1w' THEN 2 WHEN 'bold' THEN 3 END AS p FROM {scans}) WHERE p IS NOT NULL GROUP BY sub")
def priority_pick(scans):
    d = scans.groupBy("sub", "suffix").agg(F.min("name").alias("name"))
    return D.first_by_priority(d, ["sub"], "suffix", ["T2w", "T1w", "bold"]).select("sub", "name")


@query("rank_shard", "scans", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY path, id) - 1 AS p FROM {scans}) WHERE p % 4 = 1")
def rank_shard(scans):
    return D.shard(scans.select("id", "path"), ["path", "id"], 1, 4).select("id")


@query("resume_anti", "scans", "SELECT id FROM {scans} WHERE id % 3 <> 0")
def resume_anti(scans):
    return D.not_done(scans.select("id", "path"), scans.where("id % 3 = 0").select("path"), "path").select("id")


@query("limit_dry_run", "scans", "SELECT id, path FROM {scans} ORDER BY path, id LIMIT 25")
def limit_dry_run(scans):
    return scans.orderBy("path", "id").limit(25).select("id", "path")


@query("catalog_lookup", "lineitem", "SELECT l_returnflag AS task, CASE l_returnflag WHEN 'A' THEN 501 WHEN 'N' THEN CASE l_linestatus WHEN 'F' THEN 610 ELSE 611 END END AS nnunet_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def catalog_lookup(lineitem):
    spec = F.create_map(F.lit("A"), F.create_map(F.lit("*"), F.lit(501)), F.lit("N"), F.create_map(F.lit("F"), F.lit(610), F.lit("O"), F.lit(611)))
    ids = F.try_element_at(spec, F.col("l_returnflag"))
    return lineitem.select(F.col("l_returnflag").alias("task"), F.coalesce(F.try_element_at(ids, F.lit("*")), F.try_element_at(ids, F.col("l_linestatus"))).alias("nnunet_id")).groupBy("task", "nnunet_id").agg(F.count("*").alias("n"))


_FEATURE_NAME = "CASE p_partkey % 5 WHEN 0 THEN 'original_firstorder_' WHEN 1 THEN 'original_GLCM_' WHEN 2 THEN 'original_shape_' WHEN 3 THEN 'diagnostics_' ELSE 'wm_' END || replace(p_name, ' ', '') || p_partkey"


def _features(part):
    head = F.element_at(F.array(*map(F.lit, ("original_firstorder_", "original_GLCM_", "original_shape_", "diagnostics_", "wm_"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select(F.concat(head, F.replace("p_name", F.lit(" "), F.lit("")), "p_partkey").alias("name"))


@query("feature_family", "part", f"SELECT {_FEATURE_NAME} AS name, CASE p_partkey % 5 WHEN 0 THEN 'firstorder' WHEN 1 THEN 'glcm' WHEN 2 THEN 'shape' ELSE 'other' END AS family FROM part")
def feature_family(part):
    return _features(part).select("name", N.feature_family(F.col("name")).alias("family"))


@query("feature_cols", "part", f"SELECT {_FEATURE_NAME} AS name FROM part WHERE p_partkey % 5 <> 3")
def feature_cols(part):
    return _features(part).where(~F.startswith("name", F.lit("diagnostics_")))


@query("feature_filter", "part", f"SELECT {_FEATURE_NAME} AS name, NOT (p_partkey % 5 = 2 OR p_partkey IN (10, 11)) AS kept FROM part")
def feature_filter(part):
    f = _features(part)
    return f.select("name", (~((N.feature_family(F.col("name")) == "shape") | F.col("name").rlike(r"\D1[01]$"))).alias("kept"))


@query("feature_log", "part", "SELECT CASE p_partkey % 5 WHEN 0 THEN 'firstorder' WHEN 1 THEN 'glcm' WHEN 2 THEN 'shape' ELSE 'other' END AS family, count(*) FILTER (WHERE p_partkey % 5 <> 2) AS kept, count(*) FILTER (WHERE p_partkey % 5 = 2) AS excluded FROM part GROUP BY 1")
def feature_log(part):
    f = _features(part).withColumn("family", N.feature_family(F.col("name")))
    return f.groupBy("family").agg(F.count_if(F.col("family") != "shape").alias("kept"), F.count_if(F.col("family") == "shape").alias("excluded"))


@query("short_name", "part", f"SELECT {_FEATURE_NAME} AS name, CASE WHEN p_partkey % 5 IN (0, 2) THEN replace(p_name, ' ', '') || p_partkey ELSE {_FEATURE_NAME} END AS short FROM part")
def short_name(part):
    return _features(part).select("name", N.short_name(F.col("name")).alias("short"))


@query("harmonise_cols", "scans", "SELECT id, suffix AS modality, substr(ses, 1, 7) AS scanner, 'unknown' AS vendor, 'unknown' AS cohort FROM {scans}")
def harmonise_cols(scans):
    from scanframe.operators.tabular import harmonise

    return harmonise(scans.select("id", F.col("suffix").alias("modality_id"), F.substring("ses", 1, 7).alias("scanner_model"))).select("id", "modality", "scanner", "vendor", "cohort")


@query("scanner_isolation", "scans", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN sub < 'S006' AND ses LIKE 'OXF1%' THEN 'test' WHEN sub >= 'S006' AND ses NOT LIKE 'OXF1%' THEN 'trainval' WHEN sub >= 'S006' THEN 'discarded' ELSE 'none' END AS part FROM {scans}) GROUP BY 1")
def scanner_isolation(scans):
    from scanframe.operators.sampling import isolation

    return scans.select(isolation(F.col("sub") < "S006", F.startswith("ses", F.lit("OXF1"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("contrast_filter", "scans", "SELECT id FROM {scans} WHERE suffix = 'bold'")
def contrast_filter(scans):
    return scans.where(F.col("suffix") == "bold").select("id")


@query("prefix_flag", "synths", "SELECT id % 2 = 0 AS even, count(*) AS n FROM {synths} GROUP BY 1")
def prefix_flag(synths):
    return D.discover_synthetic(synths).where(F.startswith("modality_id", F.lit("syn-"))).groupBy((F.col("id") % 2 == 0).alias("even")).agg(F.count("*").alias("n"))


@query("regex_extract_label", "synths", "SELECT 'synthetic_v' || (id % 5) AS label, count(*) AS n FROM {synths} GROUP BY 1")
def regex_extract_label(synths):
    return synths.select(F.regexp_extract("path", "(synthetic_[^/]+)", 1).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("enabled_parse", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 3) THEN false ELSE true END AS enabled FROM orders")
def enabled_parse(orders):
    cells = F.array(*[F.lit(x).cast("string") for x in (" No", "TRUE ", "1", "0", None, "", "  Y")])
    return orders.select("o_orderkey", N.parse_enabled(F.get(cells, (F.col("o_orderkey") % 7).cast("int"))).alias("enabled"))


@query("family_validate", "orders", "SELECT o_orderkey, o_orderkey % 4 <> 3 AS valid FROM orders")
def family_validate(orders):
    fam = F.element_at(F.array(F.lit("segmenter"), F.lit("v26_6"), F.lit("v8"), F.lit("26-x")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return orders.select("o_orderkey", (fam.isin("segmenter", "baseline", "real") | fam.rlike(r"^v\d+(_\d+)?[a-z]*$")).alias("valid"))


@query("nested_get", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, -1 AS missing FROM events")
def nested_get(events):
    m = F.from_json("props", "map<string,int>")
    return events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.coalesce(F.try_element_at(m, F.lit("other")), F.lit(-1)).alias("missing"))


@query("dedup_ids", "orders", "SELECT o_orderkey, 'm' || (o_custkey % 50) || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS model_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders)")
def dedup_ids(orders):
    return D.numbered_ids(orders.select("o_orderkey", F.concat(F.lit("m"), F.col("o_custkey") % 50).alias("model_id")), "model_id", "o_orderkey")


@query("strip_prefixes", "part", "SELECT p_partkey, p_name AS key FROM part")
def strip_prefixes(part):
    wrapped = F.concat(F.repeat(F.lit("module."), (F.col("p_partkey") % 3).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "_orig_mod.model.").otherwise(""), "p_name")
    return part.select("p_partkey", N.strip_prefixes(wrapped).alias("key"))


@query("fn_label_remap", "lineitem", "SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE l_linenumber END AS label, count(*) AS n FROM lineitem GROUP BY 1, 2")
def fn_label_remap(lineitem):
    return lineitem.select("l_linenumber", D.remap_in_order(F.col("l_linenumber"), [(1, 2), (2, 3)]).alias("label")).groupBy("l_linenumber", "label").agg(F.count("*").alias("n"))


@query("subject_id", "scans", "SELECT id, CASE WHEN id % 2 = 0 THEN sub ELSE name END AS subject FROM {scans}")
def subject_id(scans):
    return scans.select("id", N.subject_id(F.col("path"), F.when(F.col("id") % 2 == 0, F.col("sub"))).alias("subject"))


@query("synthseg_path", "scans", "SELECT id, '/seg/sub-' || sub || '/ses-' || ses || '/sub-' || sub || '_ses-' || ses || '_synthseg.nii.gz' AS path FROM {scans}")
def synthseg_path(scans):
    stem = F.concat(F.lit("sub-"), "sub", F.lit("_ses-"), "ses")
    return scans.select("id", F.concat(F.lit("/seg/"), F.replace(stem, F.lit("_"), F.lit("/")), F.lit("/"), stem, F.lit("_synthseg.nii.gz")).alias("path"))


@query("eval_mode_name", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '_tta' ELSE o_orderstatus END AS mode FROM orders")
def eval_mode_name(orders):
    return orders.select("o_orderkey", N.mode_name(F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 0).alias("mode"))


@query("run_naming", "orders", "SELECT o_custkey % 20 AS base, 'run' || (max(o_orderkey % 97) + 1) AS next FROM orders GROUP BY 1")
def run_naming(orders):
    d = orders.select((F.col("o_custkey") % 20).alias("base"), F.concat(F.lit("/ck/run"), F.col("o_orderkey") % 97, F.lit("/last.ckpt")).alias("path"))
    return d.groupBy("base").agg(F.concat(F.lit("run"), F.max(F.regexp_extract("path", r"/run(\d+)/", 1).cast("long")) + 1).alias("next"))


@query("join_img_mask", "scans masks", f"SELECT id FROM {{scans}} WHERE {_MASKED}")
def join_img_mask(scans, masks):
    d = scans.withColumn("mask_path", F.replace(F.replace("path", F.lit("/data/"), F.lit("/masks/")), F.lit(".nii.gz"), F.lit("_mask.nii.gz")))
    return d.join(masks.select(F.col("path").alias("mask_path")), "mask_path", "left_semi").select("id")


@query("join_done", "orders lineitem", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def join_done(orders, lineitem):
    done = lineitem.where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.not_done(orders.select("o_orderkey"), done, "o_orderkey")


@query("join_pred_gt", "orders lineitem", "SELECT count(*) FILTER (WHERE n IS NOT NULL) AS matched, count(*) FILTER (WHERE n IS NULL) AS missing, coalesce(sum(n), 0)::BIGINT AS voxels FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def join_pred_gt(orders, lineitem):
    truth = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    found, missing = D.unmatched_report(orders.select("o_orderkey"), truth, "o_orderkey")
    both = found.select("n").unionByName(missing.select(F.lit(None).cast("long").alias("n")))
    return both.agg(F.count("n").alias("matched"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("voxels"))


@query("join_seg_missing", "scans masks", "SELECT id, CASE WHEN " + _MASKED + " THEN 'seg' ELSE 'none' END AS seg FROM {scans}")
def join_seg_missing(scans, masks):
    d = scans.withColumn("mask_path", F.replace(F.replace("path", F.lit("/data/"), F.lit("/masks/")), F.lit(".nii.gz"), F.lit("_mask.nii.gz")))
    m = masks.select(F.col("path").alias("mask_path"), F.lit("seg").alias("seg")).distinct()
    return d.join(m, "mask_path", "left").select("id", F.coalesce("seg", F.lit("none")).alias("seg"))


@query("bidsify", "customer", "SELECT 'sub-' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS participant_id, 'sub-' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') || '_' || m AS file FROM customer, (VALUES ('T1w'), ('T2w'), ('FLAIR')) t(m)")
def bidsify(customer):
    raw = customer.select("c_name", F.explode(F.array(*map(F.lit, ("t1n", "t2w", "t2f")))).alias("raw"))
    suffix = F.create_map(*map(F.lit, ("t1n", "T1w", "t2w", "T2w", "t2f", "FLAIR")))
    who = F.concat(F.lit("sub-"), N.alphanumeric(F.col("c_name")))
    return raw.select(who.alias("participant_id"), F.concat_ws("_", who, suffix[F.col("raw")]).alias("file"))


@query("test_inputs", "scans", "SELECT contrast, count(*) FILTER (WHERE found) AS exported, count(*) FILTER (WHERE NOT found) AS missing FROM (SELECT s.sub, contrast, bool_or(coalesce(suffix = contrast, false)) AS found FROM (SELECT DISTINCT sub FROM {scans} WHERE sub < 'S010') s CROSS JOIN (VALUES ('T1w'), ('T2w'), ('FLAIR')) t(contrast) LEFT JOIN {scans} i ON i.sub = s.sub GROUP BY 1, 2) GROUP BY 1")
def test_inputs(scans):
    wanted = scans.where("sub < 'S010'").select("sub").distinct().select("sub", F.explode(F.array(*map(F.lit, ("T1w", "T2w", "FLAIR")))).alias("contrast"))
    have = scans.select("sub", F.col("suffix").alias("contrast"), F.lit(True).alias("found")).distinct()
    return wanted.join(have, ["sub", "contrast"], "left").groupBy("contrast").agg(F.count("found").alias("exported"), F.count_if(F.col("found").isNull()).alias("missing"))


@query("struct_lint", "scans", "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN path LIKE '%/derivatives/%' THEN 'in derivatives' END, CASE WHEN ses LIKE 'LAB9%' THEN 'unknown scanner' END, CASE WHEN suffix = 'defacemask' THEN 'not an image' END]) AS rule FROM {scans}) WHERE rule IS NOT NULL GROUP BY 1")
def struct_lint(scans):
    rules = {"in derivatives": F.contains("path", F.lit("/derivatives/")), "unknown scanner": N.scanner(F.col("ses"))["vendor"] == "Unknown", "not an image": F.col("suffix") == "defacemask"}
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    return scans.select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
