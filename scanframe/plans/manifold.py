"""Queries on populations in a vector space."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.operators import manifold as M
from scanframe.operators import tabular as T
from scanframe.operators.neighbors import knn
from scanframe.plans.catalog import query

r6 = lambda c: F.round(c, 6)
GROUP = ["modality", "scanner"]


def _vec(feats):
    return feats.withColumn("vec", F.transform("embedding", lambda x: x.cast("double")))


_V = "f AS (SELECT vec_id, cohort, modality, scanner, embedding::DOUBLE[] AS vec FROM {feats})"
_Z = "f AS (SELECT vec_id, cohort, modality, scanner, list((v - m) / s ORDER BY dim) AS vec FROM {long} l JOIN (SELECT dim AS d, avg(v) AS m, stddev_pop(v) AS s FROM {long} GROUP BY dim) q ON l.dim = q.d GROUP BY ALL)"
_NAMES = [(f, f"{f:.2f}x_scale") for f in M.FRACTIONS]


def _nn(name: str, a: str, b: str, on: str = "true") -> str:
    return f"{name} AS (SELECT a.vec_id, a.modality, a.scanner, min(list_distance(a.vec, b.vec)) AS dist FROM f a JOIN f b ON {on} AND a.cohort = '{a}' AND b.cohort = '{b}' AND a.vec_id <> b.vec_id GROUP BY ALL)"


@query("cov_metrics", "feats", f"""WITH {_Z}, {_nn('o2s', 'real', 'synth')}, {_nn('s2o', 'synth', 'real')}, {_nn('oo', 'real', 'real')}, {_nn('ss', 'synth', 'synth')},
r AS (SELECT quantile_cont(dist, 0.5) AS ref FROM oo), b AS (SELECT modality, dist FROM o2s UNION ALL SELECT 'all', dist FROM o2s), l AS (SELECT modality, list(dist ORDER BY dist) AS d FROM b GROUP BY modality)
SELECT modality, len(d) AS n_original, round(ref, 6) AS ref_scale, round(list_avg(d), 6) AS mean_nn, round((SELECT quantile_cont(x, 0.5) FROM (SELECT unnest(d) AS x)), 6) AS median_nn, round((SELECT quantile_cont(x, 0.9) FROM (SELECT unnest(d) AS x)), 6) AS p90_nn,
 round(d[CASE WHEN len(d) < 2 THEN len(d) ELSE floor(0.5 * len(d))::BIGINT END], 6) AS eps_50, round(d[least(floor(0.9 * len(d))::BIGINT, len(d) - 1) + 1], 6) AS eps_90,
 {', '.join(f'round(len(list_filter(d, lambda x: x <= ref * {f})) / len(d), 6) AS "recall_{n}"' for f, n in _NAMES)}, {', '.join(f'round((SELECT avg((dist <= ref * {f})::INT) FROM s2o), 6) AS "precision_{n}"' for f, n in _NAMES)},
 (SELECT count(*) FROM ss) AS n_synthetic, round((SELECT avg(dist) FROM ss), 6) AS diversity, round((SELECT avg(dist) FROM ss) / greatest(ref, 1e-9), 6) AS spread_ratio FROM l, r""")
def cov_metrics(feats):
    c = M.coverage(M.zscored(feats))
    return c.select(*[F.col(n) if n in ("modality", "n_original", "n_synthetic") else r6(F.col(f"`{n}`")).alias(n) for n in c.columns])


@query("cov_cluster", "feats", f"WITH {_V}, {_nn('o2s', 'real', 'synth')} SELECT scanner, modality, count(*) AS n_original, round(avg(dist), 6) AS mean_nn, round(avg(dist) / 2.5, 6) AS mean_scaled, " + ", ".join(f'round(avg((dist <= 2.5 * {f})::INT), 6) AS "recall_{f:.2f}x"' for f in M.FRACTIONS) + " FROM o2s GROUP BY ALL")
def cov_cluster(feats):
    c = M.cluster_coverage(_vec(feats), 2.5, ["scanner", "modality"])
    return c.select("scanner", "modality", "n_original", *[r6(F.col(f"`{n}`")).alias(n) for n in c.columns[3:]])


@query("cov_recall_curve", "feats", f"WITH {_V}, {_nn('o2s', 'real', 'synth')}, t AS (SELECT modality AS m, quantile_cont(dist, 0.99) AS top FROM o2s GROUP BY 1) SELECT modality, k::INT AS step, round(any_value(top) * k / 299, 6) AS eps, round(avg((dist <= top * k / 299)::INT), 6) AS recall FROM o2s JOIN t ON m = modality, range(0, 300) q(k) GROUP BY modality, k")
def cov_recall_curve(feats):
    real, synth = M.split(_vec(feats))
    d = knn(real, synth, "vec_id", "vec", 1).select(F.col("q").alias("vec_id"), "dist").join(real.select("vec_id", "modality"), "vec_id")
    return M.recall_curve(d, ["modality"], 300).select("modality", "step", r6("eps").alias("eps"), r6("recall").alias("recall"))


@query("cov_grid", "feats", """WITH f AS (SELECT cohort, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM {feats}), g AS (SELECT i::INT AS i, j::INT AS j, -2 + i * 0.5 AS x, -2 + j * 0.5 AS y FROM range(0, 9) p(i), range(0, 9) q(j))
SELECT i, j, count(*) FILTER (WHERE cohort = 'real') AS n_real, round(coalesce(avg(near) FILTER (WHERE cohort = 'real'), 0), 6) AS recall FROM (SELECT i, j, cohort, (d <= 0.2)::INT AS near FROM (SELECT i, j, f.cohort, f.a, f.b, (SELECT min(sqrt((s.a - f.a) ** 2 + (s.b - f.b) ** 2)) FROM f s WHERE s.cohort = 'synth') AS d FROM g JOIN f ON floor((f.a + 2) / 0.5) = i AND floor((f.b + 2) / 0.5) = j)) GROUP BY i, j""")
def cov_grid(feats):
    d = feats.withColumn("vec", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")))
    real, synth = M.split(d)
    near = knn(real, synth, "vec_id", "vec", 1).select(F.col("q").alias("vec_id"), "dist")
    cell = lambda k: F.floor((F.col("vec")[k] + 2) / 0.5).cast("int")
    every = d.select("vec_id", cell(0).alias("i"), cell(1).alias("j")).where("i BETWEEN 0 AND 8 AND j BETWEEN 0 AND 8").join(near, "vec_id", "left")
    return every.groupBy("i", "j").agg(F.count("dist").alias("n_real"), r6(F.coalesce(F.avg((F.col("dist") <= 0.2).cast("double")), F.lit(0.0))).alias("recall"))


@query("cov_spread", "long", "SELECT dim, round(stddev_pop(v) FILTER (WHERE cohort = 'synth') / stddev_pop(v) FILTER (WHERE cohort = 'real'), 6) AS ratio FROM {long} GROUP BY dim")
def cov_spread(long):
    sd = lambda c: F.stddev_pop(F.when(F.col("cohort") == c, F.col("v")))
    return long.groupBy("dim").agg(r6(F.try_divide(sd("synth"), sd("real"))).alias("ratio"))


@query("join_knn_1", "feats", f"WITH {_V}, {_nn('n', 'real', 'synth')} SELECT vec_id, round(dist, 6) AS dist FROM n")
def join_knn_1(feats):
    real, synth = M.split(_vec(feats))
    return knn(real, synth, "vec_id", "vec", 1).select(F.col("q").alias("vec_id"), r6("dist").alias("dist"))


@query("join_dist_full", "feats", f"WITH {_V}, n AS (SELECT a.vec_id, b.modality, b.scanner, min(list_distance(a.vec, b.vec)) AS dist FROM f a JOIN f b ON a.cohort = 'synth' AND b.cohort = 'real' GROUP BY ALL) SELECT vec_id, modality, scanner, round(dist, 6) AS dist FROM n")
def join_dist_full(feats):
    return M.against_groups(_vec(feats), GROUP).select("vec_id", *GROUP, r6("dist").alias("dist"))


@query("knn_self", "feats", f"WITH {_V}, {_nn('n', 'real', 'real', 'a.modality = b.modality AND a.scanner = b.scanner')} SELECT modality, scanner, round(quantile_cont(dist, 0.5), 6) AS median_nn, round(quantile_cont(dist, 0.95), 6) AS p95_nn FROM n GROUP BY ALL")
def knn_self(feats):
    return M.self_distances(M.split(_vec(feats))[0], GROUP).select(*GROUP, r6("median_nn").alias("median_nn"), r6("p95_nn").alias("p95_nn"))


_AGAINST = f"{_V}, {_nn('n', 'real', 'real', 'a.modality = b.modality AND a.scanner = b.scanner')}, g AS (SELECT modality, scanner, quantile_cont(dist, 0.5) AS med, quantile_cont(dist, 0.95) AS p95, count(*) AS n_real FROM n GROUP BY ALL), d AS (SELECT a.vec_id, a.vec, b.modality, b.scanner, min(list_distance(a.vec, b.vec)) AS dist FROM f a JOIN f b ON a.cohort = 'synth' AND b.cohort = 'real' GROUP BY ALL), w AS (SELECT d.*, n_real, med, p95, dist <= p95 AS ind, dist / greatest(med, 1e-8) AS norm FROM d JOIN g USING (modality, scanner))"


@query("ind_ood", "feats", f"WITH {_AGAINST} SELECT vec_id, modality, scanner, ind, round(norm, 6) AS norm FROM w")
def ind_ood(feats):
    return M.against_groups(_vec(feats), GROUP).select("vec_id", *GROUP, "ind", r6("norm").alias("norm"))


@query("ood_stats", "feats", f"WITH {_AGAINST} SELECT modality, scanner, count(*) FILTER (WHERE NOT ind) AS n_ood, round(avg(norm) FILTER (WHERE NOT ind), 6) AS ood_mean, round(var_pop(norm) FILTER (WHERE NOT ind), 6) AS ood_var FROM w GROUP BY ALL")
def ood_stats(feats):
    a = M.against_groups(_vec(feats), GROUP)
    o = F.when(~F.col("ind"), F.col("norm"))
    return a.groupBy(*GROUP).agg(F.count(o).alias("n_ood"), r6(F.avg(o)).alias("ood_mean"), r6(F.var_pop(o)).alias("ood_var"))


_PRDC = f"""WITH {_AGAINST}, c AS (SELECT modality, scanner, any_value(n_real) AS n_real, count(*) FILTER (WHERE ind) AS n_ind, count(*) FILTER (WHERE NOT ind) AS n_ood, CASE WHEN count(*) FILTER (WHERE ind) > 1 THEN least(3, any_value(n_real) - 1, count(*) FILTER (WHERE ind) - 2) ELSE 0 END AS k FROM w GROUP BY ALL),
u AS (SELECT * FROM c WHERE n_real >= 4 AND n_ind >= 5 AND k >= 1), re AS (SELECT f.vec_id, f.vec, f.modality, f.scanner, k FROM f JOIN u USING (modality, scanner) WHERE cohort = 'real'), fa AS (SELECT w.vec_id, w.vec, w.modality, w.scanner, k FROM w JOIN u USING (modality, scanner) WHERE ind),
rr AS (SELECT vec_id, vec, modality, scanner, dist AS radius FROM (SELECT a.*, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.modality, a.scanner, a.vec_id ORDER BY list_distance(a.vec, b.vec)) AS n FROM re a JOIN re b ON a.modality = b.modality AND a.scanner = b.scanner AND a.vec_id <> b.vec_id) WHERE n = k),
fr AS (SELECT vec_id, vec, modality, scanner, dist AS radius FROM (SELECT a.*, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.modality, a.scanner, a.vec_id ORDER BY list_distance(a.vec, b.vec)) AS n FROM fa a JOIN fa b ON a.modality = b.modality AND a.scanner = b.scanner AND a.vec_id <> b.vec_id) WHERE n = k),
x AS (SELECT rr.modality, rr.scanner, rr.vec_id AS r, fr.vec_id AS s, list_distance(rr.vec, fr.vec) AS d, rr.radius AS a, fr.radius AS b FROM rr JOIN fr ON rr.modality = fr.modality AND rr.scanner = fr.scanner),
p AS (SELECT modality, scanner, avg((n > 0)::INT) AS precision, avg(n) AS dense FROM (SELECT modality, scanner, s, count(*) FILTER (WHERE d < a) AS n FROM x GROUP BY ALL) GROUP BY ALL),
q AS (SELECT modality, scanner, avg((n > 0)::INT) AS recall, avg((m < a)::INT) AS coverage FROM (SELECT modality, scanner, r, a, count(*) FILTER (WHERE d < b) AS n, min(d) AS m FROM x GROUP BY ALL) GROUP BY ALL)
SELECT modality, scanner, n_real, n_ind, n_ood, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(dense / k, 6) AS density, round(coverage, 6) AS coverage FROM c LEFT JOIN p USING (modality, scanner) LEFT JOIN q USING (modality, scanner)"""


@query("prdc", "feats", _PRDC)
def prdc(feats):
    p = M.prdc(_vec(feats), GROUP)
    return p.select(*GROUP, "n_real", "n_ind", "n_ood", F.col("k").cast("long").alias("k"), *[r6(c).alias(c) for c in ("precision", "recall", "density", "coverage")])


@query("prdc_group", "feats", f"WITH {_AGAINST} SELECT modality, scanner, any_value(n_real) AS n_real, round(any_value(med), 6) AS median_nn, round(any_value(p95), 6) AS p95_nn, round(100.0 * count(*) FILTER (WHERE NOT ind) / count(*), 2) AS ood_pct FROM w GROUP BY ALL")
def prdc_group(feats):
    a = M.against_groups(_vec(feats), GROUP)
    return a.groupBy(*GROUP).agg(F.first("n_real").alias("n_real"), r6(F.first("median_nn")).alias("median_nn"), r6(F.first("p95_nn")).alias("p95_nn"), F.round(100 * F.count_if(~F.col("ind")) / F.count(F.lit(1)), 2).alias("ood_pct"))


_CENT = "c AS (SELECT modality AS m, list(v ORDER BY dim) AS c FROM (SELECT modality, dim, avg(v) AS v FROM {long} GROUP BY ALL) GROUP BY 1)"


@query("fs_nearest_centroid", "feats", f"WITH {_V}, {_CENT} SELECT vec_id, arg_min(m, (d, m)) AS nearest, round(min(d), 6) AS dist FROM (SELECT vec_id, m, list_distance(vec, c) AS d FROM f, c) GROUP BY vec_id")
def fs_nearest_centroid(feats):
    return M.nearest_centroid(_vec(feats), "modality").select("vec_id", "nearest", r6("dist").alias("dist"))


@query("join_argmin_centroid", "feats", f"WITH {_V}, {_CENT} SELECT nearest, count(*) AS n FROM (SELECT vec_id, arg_min(m, (d, m)) AS nearest FROM (SELECT vec_id, m, list_distance(vec, c) AS d FROM f, c) GROUP BY vec_id) GROUP BY nearest")
def join_argmin_centroid(feats):
    return M.nearest_centroid(_vec(feats), "modality").groupBy("nearest").agg(F.count(F.lit(1)).alias("n"))


@query("join_topk_centroid", "feats", f"WITH {_V}, c AS (SELECT modality AS m, scanner AS s, list(v ORDER BY dim) AS c FROM (SELECT modality, scanner, dim, avg(v) AS v FROM {{long}} WHERE cohort = 'real' GROUP BY ALL) GROUP BY ALL) SELECT m AS modality, s AS scanner, vec_id, rank FROM (SELECT m, s, vec_id, row_number() OVER (PARTITION BY m, s ORDER BY round(list_distance(vec, c), 9), vec_id)::INT AS rank FROM f, c WHERE cohort = 'synth') WHERE rank <= 3")
def join_topk_centroid(feats):
    real, synth = M.split(_vec(feats))
    return M.nearest_to_centroids(real, synth, GROUP, 3).select(*GROUP, "vec_id", "rank")


@query("fs_anova", "long", "WITH g AS (SELECT dim, modality, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM {long} GROUP BY ALL), t AS (SELECT dim, avg(v) AS gm FROM {long} GROUP BY dim) SELECT g.dim, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 6) AS f FROM g JOIN t ON g.dim = t.dim GROUP BY g.dim")
def fs_anova(long):
    return T.one_way_f(long, "modality").select("dim", r6("f").alias("f"))


@query("fs_cohens_d", "long", "SELECT dim, round((mb - ma) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0), 6) AS d FROM (SELECT dim, " + ", ".join(f"avg(v) FILTER (WHERE cohort = '{c}') AS m{k}, var_samp(v) FILTER (WHERE cohort = '{c}') AS v{k}, count(*) FILTER (WHERE cohort = '{c}') AS n{k}" for c, k in (("real", "a"), ("synth", "b"))) + " FROM {long} GROUP BY dim)")
def fs_cohens_d(long):
    return T.cohens_d(long, "cohort", "real", "synth").select("dim", r6("d").alias("d"))


@query("fs_spearman", "long", "SELECT dim, round(corr(rx, ry), 6) AS rho FROM (SELECT l.dim, rank() OVER (PARTITION BY l.dim ORDER BY l.v) + (count(*) OVER (PARTITION BY l.dim, l.v) - 1) / 2 AS rx, rank() OVER (PARTITION BY l.dim ORDER BY a.v) + (count(*) OVER (PARTITION BY l.dim, a.v) - 1) / 2 AS ry FROM {long} l JOIN {long} a ON a.vec_id = l.vec_id AND a.dim = 0 WHERE l.dim > 0) GROUP BY dim")
def fs_spearman(long):
    axis = long.where("dim = 0").select("vec_id", F.col("v").alias("axis"))
    return T.spearman(long.where("dim > 0").join(axis, "vec_id"), ["dim"], "v", "axis").select("dim", r6("rho").alias("rho"))


@query("fs_outliers", "feats", f"WITH {_Z} SELECT vec_id, round(list_max(list_transform(vec, lambda x: abs(x))), 6) AS max_z, list_max(list_transform(vec, lambda x: abs(x))) <= 3.0 AS kept FROM f")
def fs_outliers(feats):
    return M.outliers(feats.withColumnRenamed("embedding", "vec_raw"), 3.0).select("vec_id", r6("max_z").alias("max_z"), "kept")


@query("graph_sym", "lineitem", "SELECT src, dst, round(sum(w) / 2, 6) AS w FROM (SELECT l_suppkey AS src, l_partkey % 100 + 1000 AS dst, sum(l_discount) AS w FROM lineitem GROUP BY ALL UNION ALL SELECT l_partkey % 100 + 1000, l_suppkey, sum(l_discount) FROM lineitem GROUP BY ALL) GROUP BY ALL")
def graph_sym(lineitem):
    e = lineitem.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1000).alias("dst")).agg(F.sum("l_discount").alias("w"))
    return M.symmetric(e).select("src", "dst", r6("w").alias("w"))
