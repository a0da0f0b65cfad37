"""Queries on feature tables, score rows, samples, splits and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.functions import names as N
from scanframe.functions import rng
from scanframe.operators import sampling as S
from scanframe.operators import tabular as T
from scanframe.plans.catalog import query

r6 = lambda c: F.round(c, 6)


@query("drop_all_nan", "dirty", "SELECT dim, count(v) AS n FROM {dirty} GROUP BY dim HAVING count(v) > 0")
def drop_all_nan(dirty):
    return T.drop_all_missing(dirty).groupBy("dim").agg(F.count("v").alias("n"))


@query("drop_zero_var", "dirty", "SELECT dim, count(v) AS n FROM {dirty} GROUP BY dim HAVING var_pop(v) > 0")
def drop_zero_var(dirty):
    return T.drop_constant(dirty).groupBy("dim").agg(F.count("v").alias("n"))


@query("align_common", "dirty", "SELECT DISTINCT dim FROM {dirty} WHERE cohort = 'real' AND dim % 3 <> 0 INTERSECT SELECT dim FROM {dirty} WHERE cohort = 'synth' AND dim % 4 <> 0")
def align_common(dirty):
    a = dirty.where("cohort = 'real' AND dim % 3 <> 0").select("dim")
    b = dirty.where("cohort = 'synth' AND dim % 4 <> 0").select("dim")
    return a.intersect(b)


_MATRIX = """WITH s AS (SELECT dim, avg(v) AS m FROM {dirty} WHERE %s GROUP BY dim HAVING count(v) > 0 AND var_pop(v) > 0)
SELECT vec_id, d.dim, round(coalesce(v, m), 6) AS v FROM {dirty} d JOIN s ON d.dim = s.dim"""


@query("fs_build_matrix", "dirty", _MATRIX % "true")
def fs_build_matrix(dirty):
    return T.build_matrix(dirty).select("vec_id", "dim", r6("v").alias("v"))


@query("fs_impute_orig", "dirty", _MATRIX % "cohort = 'real'")
def fs_impute_orig(dirty):
    return T.build_matrix(dirty, F.col("cohort") == "real").select("vec_id", "dim", r6("v").alias("v"))


@query("fs_impute_zero", "dirty", "SELECT dim, round(sum(coalesce(v, 0)), 6) AS total FROM {dirty} GROUP BY dim")
def fs_impute_zero(dirty):
    return dirty.groupBy("dim").agg(r6(F.sum(F.coalesce("v", F.lit(0.0)))).alias("total"))


@query("fs_zscore", "long", "SELECT vec_id, dim, round((v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim), 6) AS z FROM {long}")
def fs_zscore(long):
    return T.zscore(long).select("vec_id", "dim", r6("v").alias("z"))


_WM_NAME = "CASE dim % 4 WHEN 0 THEN 'r_firstorder_Mean' WHEN 1 THEN 'r_firstorder_Variance' WHEN 2 THEN 'r_firstorder_Entropy' ELSE 'r_shape_Mean' END || CASE WHEN dim < 4 THEN '' ELSE '' END"


@query("fs_wm_ratio", "long", """WITH r AS (SELECT vec_id, avg(v + 10) AS ref FROM {long} WHERE dim IN (0, 4) GROUP BY vec_id)
SELECT l.vec_id, dim, round(CASE dim % 4 WHEN 0 THEN (v + 10) / ref WHEN 1 THEN (v + 10) / (ref * ref) ELSE v + 10 END, 6) AS v FROM {long} l JOIN r ON l.vec_id = r.vec_id""")
def fs_wm_ratio(long):
    ending = F.element_at(F.array(*map(F.lit, ("_firstorder_Mean", "_firstorder_Variance", "_firstorder_Entropy", "_shape_Mean"))), F.col("dim") % 4 + 1)
    named = long.select("vec_id", "dim", F.concat(F.lit("r"), "dim", ending).alias("name"), (F.col("v") + 10).alias("v"))
    return T.white_matter_ratio(named, "vec_id", "name", ["r0_firstorder_Mean", "r4_firstorder_Mean"]).select("vec_id", "dim", r6("v").alias("v"))


@query("agg_mean_dice", "evals", "SELECT run_id, split_part(run_id, '_', 1) AS method, contrast, class, round(avg(value), 6) AS value FROM {evals} GROUP BY ALL")
def agg_mean_dice(evals):
    return evals.groupBy("run_id", N.method_of_run(F.col("run_id")).alias("method"), "contrast", "class").agg(r6(F.avg("value")).alias("value"))


_CONTRASTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("agg_pivot", "evals", "SELECT run_id, " + ", ".join(f"round(avg(value) FILTER (WHERE contrast = '{c}' AND class = {k}), 6) AS c{c[0]}_{k}" for c in _CONTRASTS for k in (1, 2, 3)) + " FROM {evals} GROUP BY run_id")
def agg_pivot(evals):
    cols = {f"c{c[0]}_{k}": (F.col("contrast") == c) & (F.col("class") == k) for c in _CONTRASTS for k in (1, 2, 3)}
    out = T.pivot_scores(evals, ["run_id"], cols)
    return out.select("run_id", *[r6(c).alias(c) for c in cols])


@query("agg_overall", "evals", "SELECT run_id, round(avg(m), 3) AS overall FROM (SELECT run_id, contrast, class, avg(value) AS m FROM {evals} GROUP BY ALL) GROUP BY run_id")
def agg_overall(evals):
    return T.mean_of_groups(evals, ["run_id", "contrast", "class"], ["run_id"]).select("run_id", F.round("mean", 3).alias("overall"))


@query("agg_macro", "evals", "SELECT run_id, round(avg(m), 6) AS macro FROM (SELECT run_id, contrast, avg(m) AS m FROM (SELECT run_id, contrast, class, avg(value) AS m FROM {evals} GROUP BY ALL) GROUP BY ALL) GROUP BY run_id")
def agg_macro(evals):
    per = T.mean_of_groups(evals, ["run_id", "contrast", "class"], ["run_id", "contrast"])
    return per.groupBy("run_id").agg(r6(F.avg("mean")).alias("macro"))


@query("agg_mean_std", "evals", "SELECT class, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM {evals} GROUP BY class")
def agg_mean_std(evals):
    return evals.groupBy("class").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), F.count("value").alias("n"))


@query("agg_domain", "evals", "SELECT run_id, round(avg(m) FILTER (WHERE contrast = '1-URGENT'), 6) AS in_domain, round(avg(m) FILTER (WHERE contrast <> '1-URGENT'), 6) AS ood_mean, round(min(m) FILTER (WHERE contrast <> '1-URGENT'), 6) AS ood_worst FROM (SELECT run_id, contrast, avg(value) AS m FROM {evals} GROUP BY ALL) GROUP BY run_id")
def agg_domain(evals):
    means = evals.groupBy("run_id", "contrast").agg(F.avg("value").alias("mean"))
    d = T.domain_scores(means, "run_id", "contrast", "1-URGENT")
    return d.select("run_id", r6("in_domain").alias("in_domain"), r6("ood_mean").alias("ood_mean"), r6("ood_worst").alias("ood_worst"))


@query("agg_count_by", "scans", "SELECT sub, count(*) AS n, arg_max(suffix, (c, suffix)) AS modal FROM (SELECT sub, suffix, count(*) OVER (PARTITION BY sub, suffix) AS c FROM {scans}) GROUP BY sub")
def agg_count_by(scans):
    c = scans.groupBy("sub", "suffix").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("sub").agg(F.sum("c").alias("n"), F.max_by("suffix", F.struct("c", "suffix")).alias("modal"))


@query("agg_distinct", "scans", "SELECT suffix, count(DISTINCT sub) AS subjects, array_to_string(list_sort(list(DISTINCT substr(ses, 1, 7))), ',') AS scanners FROM {scans} GROUP BY suffix")
def agg_distinct(scans):
    return scans.groupBy("suffix").agg(F.count_distinct("sub").alias("subjects"), F.array_join(F.array_sort(F.collect_set(F.substring("ses", 1, 7))), ",").alias("scanners"))


@query("agg_group_centroid", "long", "SELECT cohort, modality, dim, round(avg(v), 6) AS v FROM {long} GROUP BY ALL")
def agg_group_centroid(long):
    return long.groupBy("cohort", "modality", "dim").agg(r6(F.avg("v")).alias("v"))


@query("agg_slice_mean", "vox", "SELECT vol, label, round(avg(v), 6) AS v FROM {vox} JOIN (SELECT vol AS w, max(z) AS top FROM {vox} GROUP BY vol) ON vol = w WHERE abs(2 * z - top) <= 2 GROUP BY vol, label")
def agg_slice_mean(vox):
    """Means over the middle slices of each volume: those at most one place from its centre."""
    top = vox.groupBy("vol").agg(F.max("z").alias("top"))
    return vox.join(top, "vol").where(F.abs(2 * F.col("z") - F.col("top")) <= 2).groupBy("vol", "label").agg(r6(F.avg("v")).alias("v"))


@query("agg_ens_prob", "long", "SELECT vec_id % 100 AS voxel, arg_max(c, (p, -c)) AS label, round(max(p), 6) AS p FROM (SELECT vec_id, c, avg(p) AS p FROM (SELECT vec_id % 100 AS vec_id, dim % 4 AS c, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id, dim // 4) AS p FROM {long}) GROUP BY ALL) GROUP BY 1")
def agg_ens_prob(long):
    p = long.select((F.col("vec_id") % 100).alias("voxel"), (F.col("dim") % 4).alias("c"), (F.exp("v") / F.sum(F.exp("v")).over(W.partitionBy("vec_id", F.floor(F.col("dim") / 4)))).alias("p"))
    mean = p.groupBy("voxel", "c").agg(F.avg("p").alias("p"))
    return mean.groupBy("voxel").agg(F.max_by("c", F.struct("p", -F.col("c"))).alias("label"), r6(F.max("p")).alias("p"))


@query("sort_desc", "lineitem", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_partkey")
def sort_desc(lineitem):
    return lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"), "l_partkey")


@query("topk", "long", "SELECT dim, vec_id, rank FROM (SELECT dim, vec_id, row_number() OVER (PARTITION BY dim ORDER BY v DESC, vec_id)::INT AS rank FROM {long}) WHERE rank <= 10")
def topk(long):
    return T.top_k(long, ["dim"], [F.desc("v"), F.col("vec_id")], 10).select("dim", "vec_id", "rank")


@query("argsort", "long", "SELECT vec_id, dim, (row_number() OVER (PARTITION BY vec_id ORDER BY v, dim) - 1)::INT AS pos FROM {long}")
def argsort(long):
    return long.select("vec_id", "dim", (F.row_number().over(W.partitionBy("vec_id").orderBy("v", "dim")) - 1).alias("pos"))


_U = "('0x' || substr(md5(concat_ws(':', {0})), 1, 8))::UBIGINT / 4294967296.0"


@query("rng_shared", "customer", "SELECT c_custkey, round(" + _U.format("'42', 'draw', c_custkey::VARCHAR") + ", 9) AS u, " + _U.format("'42', 'gate', c_custkey::VARCHAR") + " < 0.3 AS gate, floor(" + _U.format("'42', 'int', c_custkey::VARCHAR") + " * 5)::INT + 2 AS pick FROM customer")
def rng_shared(customer):
    return customer.select("c_custkey", F.round(rng.uniform(42, "draw", "c_custkey"), 9).alias("u"), rng.gate(0.3, 42, "gate", "c_custkey").alias("gate"), rng.choice([2, 3, 4, 5, 6], 42, "int", "c_custkey").alias("pick"))


@query("rng_uniform_gate", "customer", "SELECT c_nationkey, count(*) FILTER (WHERE " + _U.format("'7', 'g', c_custkey::VARCHAR") + " < 0.5) AS n, round(avg(-1 + 3 * " + _U.format("'7', 'r', c_custkey::VARCHAR") + "), 6) AS mean FROM customer GROUP BY 1")
def rng_uniform_gate(customer):
    return customer.groupBy("c_nationkey").agg(F.count_if(rng.gate(0.5, 7, "g", "c_custkey")).alias("n"), r6(F.avg(rng.between(-1, 2, 7, "r", "c_custkey"))).alias("mean"))


@query("sample_stratified", "scans", """WITH c AS (SELECT suffix, substr(ses, 1, 7) AS sc, count(*) AS c FROM {scans} GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY suffix) AS t, least(greatest(1, round_even(c / (sum(c) OVER (PARTITION BY suffix)) * 100, 0)), c)::BIGINT AS want FROM c),
a AS (SELECT suffix, sc, CASE WHEN t <= 100 THEN c ELSE greatest(0, least(want, 100 - coalesce(sum(want) OVER (PARTITION BY suffix ORDER BY c DESC, sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS take FROM w)
SELECT id FROM (SELECT id, take, row_number() OVER (PARTITION BY s.suffix, a.sc ORDER BY md5(concat_ws(':', '42', 'strata', id::VARCHAR)), id) AS n FROM {scans} s JOIN a ON s.suffix = a.suffix AND substr(s.ses, 1, 7) = a.sc) WHERE n <= take""")
def sample_stratified(scans):
    return S.stratified(scans.withColumn("scanner", F.substring("ses", 1, 7)), "suffix", "scanner", 100, 42, "id").select("id")


@query("sample_cap", "long", "SELECT scanner, vec_id FROM (SELECT scanner, vec_id, row_number() OVER (PARTITION BY scanner ORDER BY md5(concat_ws(':', '42', 'cap', vec_id::VARCHAR)), vec_id) AS n FROM {feats}) WHERE n <= 150")
def sample_cap(long):
    return S.hash_sample(long.where("dim = 0"), ["scanner"], 150, 42, "cap", "vec_id").select("scanner", "vec_id")


@query("sample_stride", "vox", "SELECT vol, i FROM (SELECT vol, i, count(*) OVER (PARTITION BY vol) AS n FROM {vox}) WHERE i % greatest(1, (n // 200)) = 0")
def sample_stride(vox):
    d = vox.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("vol")))
    return S.stride(d, "i", F.col("n"), 200).select("vol", "i")


@query("sample_adaptive_stride", "vox", "SELECT vol, greatest(1, round_even(pow(count(*) * 1000 / 250000.0, 1.0 / 3), 0))::INT AS step FROM {vox} GROUP BY vol")
def sample_adaptive_stride(vox):
    return vox.groupBy("vol").agg(F.count(F.lit(1)).alias("n")).select("vol", S.adaptive_step(F.col("n") * 1000).alias("step"))


@query("sample_random_fg", "vox", "SELECT vol, i FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY md5(concat_ws(':', '42', 'fg', vol::VARCHAR, i::VARCHAR)), vol, i) AS m FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY md5(concat_ws(':', '42', 'pos', vol::VARCHAR, i::VARCHAR)), vol, i) AS n FROM {vox}) WHERE n <= 400 AND v > 0.01) WHERE m <= 100")
def sample_random_fg(vox):
    some = S.hash_sample(vox, ["vol"], 400, 42, "pos", "vol", "i").where("v > 0.01")
    return S.hash_sample(some, ["vol"], 100, 42, "fg", "vol", "i").select("vol", "i")


@query("sample_crop", "vox", "SELECT vol, i FROM {vox} JOIN (SELECT vol AS w, max(z) AS mz FROM {vox} GROUP BY 1) ON vol = w WHERE z BETWEEN floor(" + _U.format("'42', 'cz', vol::VARCHAR") + " * greatest(mz + 1 - 4 + 1, 1)) AND floor(" + _U.format("'42', 'cz', vol::VARCHAR") + " * greatest(mz + 1 - 4 + 1, 1)) + 3 AND y BETWEEN floor(" + _U.format("'42', 'cy', vol::VARCHAR") + " * 8) AND floor(" + _U.format("'42', 'cy', vol::VARCHAR") + " * 8) + 3 AND x BETWEEN 3 AND 6")
def sample_crop(vox):
    from scanframe.operators.volume import random_crop

    return random_crop(vox, {"z": 4, "y": 4}, 42).where("x BETWEEN 3 AND 6").select("vol", "i")


@query("split_ratio", "scans", "SELECT sub, CASE WHEN k <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN k <= greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'test' END AS part FROM (SELECT sub, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(concat_ws(':', '12345', 'split', sub))) AS k FROM (SELECT DISTINCT sub FROM {scans}))")
def split_ratio(scans):
    return S.split_ratio(scans, "sub", 0.7, 0.15, 12345)


@query("split_kfold", "scans", "SELECT sub, (ntile(4) OVER (ORDER BY md5(concat_ws(':', '12345', 'fold', sub))) - 1)::INT AS fold FROM (SELECT DISTINCT sub FROM {scans})")
def split_kfold(scans):
    return S.k_folds(scans, "sub", 4, 12345)


_FOLDS = "SELECT c_custkey AS id, (c_custkey % 5)::BIGINT AS fold, CASE WHEN c_nationkey % 2 = 0 THEN 'train' ELSE 'val' END AS part FROM customer UNION ALL SELECT c_custkey, c_custkey % 5, 'val' FROM customer WHERE c_custkey % 50 = 0"


@query("set_disjoint_check", "customer", f"WITH f AS ({_FOLDS}) SELECT 'overlap' AS rule, count(*) AS n FROM (SELECT fold, id FROM f GROUP BY ALL HAVING count(DISTINCT part) > 1) UNION ALL SELECT 'contaminated', count(DISTINCT id) FROM f WHERE id % 90 = 0 UNION ALL SELECT 'fold out of range', count(DISTINCT fold) FROM f WHERE fold >= 4")
def set_disjoint_check(customer):
    f = customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("fold"), F.when(F.col("c_nationkey") % 2 == 0, "train").otherwise("val").alias("part"))
    f = f.unionByName(f.where("id % 50 = 0").withColumn("part", F.lit("val")))
    return S.fold_errors(f, "id", customer.where("c_custkey % 90 = 0").select(F.col("c_custkey").alias("id")), 4)


@query("split_guard_brats", "customer", "SELECT fold, count(*) AS n, count(*) FILTER (WHERE id % 7 = 0) AS held FROM (SELECT c_custkey AS id, c_custkey % 5 AS fold FROM customer) GROUP BY fold")
def split_guard_brats(customer):
    f = customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("fold"), F.when(F.col("c_custkey") % 7 == 0, "val").otherwise("train").alias("part"))
    S.check_folds(f, "id", f.where("id < 0"), 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "val").alias("held"))


@query("set_union_rows", "feats scans", "SELECT vec_id AS id, cohort, NULL::VARCHAR AS suffix FROM {feats} UNION ALL SELECT id, NULL, suffix FROM {scans}")
def set_union_rows(feats, scans):
    return feats.select(F.col("vec_id").alias("id"), "cohort").unionByName(scans.select("id", "suffix"), allowMissingColumns=True)


@query("set_vstack", "feats", "SELECT cohort, count(*) AS n FROM {feats} GROUP BY 1")
def set_vstack(feats):
    a, b = (feats.where(F.col("cohort") == c).select("vec_id", F.lit(c).alias("cohort")) for c in ("real", "synth"))
    return a.unionByName(b).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("set_intersect_cols", "scans", "SELECT DISTINCT sub FROM {scans} WHERE suffix = 'T1w' INTERSECT SELECT sub FROM {scans} WHERE suffix = 'GRE' AND id % 6 = 0")
def set_intersect_cols(scans):
    return scans.where("suffix = 'T1w'").select("sub").intersect(scans.where("suffix = 'GRE' AND id % 6 = 0").select("sub"))


@query("set_union_cols", "scans", "SELECT sub FROM {scans} WHERE suffix = 'T1w' UNION SELECT sub FROM {scans} WHERE suffix = 'bold'")
def set_union_cols(scans):
    return scans.where("suffix = 'T1w'").select("sub").union(scans.where("suffix = 'bold'").select("sub")).distinct()


@query("set_difference", "scans", "SELECT DISTINCT sub FROM {scans} EXCEPT SELECT sub FROM {scans} WHERE id % 40 = 0")
def set_difference(scans):
    return scans.select("sub").subtract(scans.where("id % 40 = 0").select("sub"))


@query("set_hstack_cols", "feats long", "SELECT f.vec_id, f.modality, round(l.v, 6) AS x FROM {feats} f JOIN {long} l ON f.vec_id = l.vec_id AND l.dim = 0")
def set_hstack_cols(feats, long):
    return feats.select("vec_id", "modality").join(long.where("dim = 0").select("vec_id", r6("v").alias("x")), "vec_id")


@query("win_rank_topk", "long", "SELECT modality, vec_id, rank FROM (SELECT modality, vec_id, row_number() OVER (PARTITION BY modality ORDER BY abs(v), vec_id)::INT AS rank FROM {long} WHERE dim = 1) WHERE rank <= 3")
def win_rank_topk(long):
    return T.top_k(long.where("dim = 1"), ["modality"], [F.abs("v"), F.col("vec_id")], 3).select("modality", "vec_id", "rank")


@query("win_best_gap", "evals", "SELECT run_id, contrast, round(gap, 6) AS gap FROM (SELECT run_id, contrast, gap, row_number() OVER (PARTITION BY run_id ORDER BY round(gap, 9) DESC, contrast) AS n FROM (SELECT run_id, contrast, max(value) - avg(value) AS gap FROM {evals} GROUP BY ALL)) WHERE n = 1")
def win_best_gap(evals):
    g = evals.groupBy("run_id", "contrast").agg((F.max("value") - F.avg("value")).alias("gap"))
    return T.top_k(g, ["run_id"], [F.desc(F.round("gap", 9)), F.col("contrast")], 1).select("run_id", "contrast", r6("gap").alias("gap"))


@query("win_auc_trapz", "lineitem", "SELECT l_returnflag, round(sum((q - pq) * (g + pg) / 2), 6) AS auc FROM (SELECT *, lag(q) OVER (PARTITION BY l_returnflag ORDER BY q) AS pq, lag(g) OVER (PARTITION BY l_returnflag ORDER BY q) AS pg FROM (SELECT l_returnflag, l_quantity AS q, avg(l_discount) AS g FROM lineitem GROUP BY ALL)) GROUP BY 1")
def win_auc_trapz(lineitem):
    from scanframe.operators.windows import trapezoid

    g = lineitem.groupBy("l_returnflag", "l_quantity").agg(F.avg("l_discount").alias("g"))
    return trapezoid(g, ["l_returnflag"], "l_quantity", "g").select("l_returnflag", r6("auc").alias("auc"))


@query("dates_run_id", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id FROM orders")
def dates_run_id(orders):
    return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("run_id"))


@query("feature_names", "region", "SELECT 'region' || r || '_bin' || lpad(b::VARCHAR, 2, '0') AS name FROM range(0, 7) t(r), range(0, 64) u(b)")
def feature_names(region):
    r = region.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("r"))
    r = r.select("r", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
    return r.select(F.concat(F.lit("region"), "r", F.lit("_bin"), F.lpad(F.col("b").cast("string"), 2, "0")).alias("name"))


@query("chan_select", "long", "SELECT vec_id, dim, round(v, 6) AS v FROM {long} WHERE dim IN (2, 5)")
def chan_select(long):
    return long.where(F.col("dim").isin(2, 5)).select("vec_id", "dim", r6("v").alias("v"))


@query("chan_stack", "long", "SELECT vec_id, round(max(v) FILTER (WHERE dim = 2), 6) AS c2, round(max(v) FILTER (WHERE dim = 5), 6) AS c5 FROM {long} GROUP BY vec_id")
def chan_stack(long):
    p = long.where(F.col("dim").isin(2, 5)).groupBy("vec_id").pivot("dim", [2, 5]).agg(F.max("v"))
    return p.select("vec_id", r6("2").alias("c2"), r6("5").alias("c5"))
