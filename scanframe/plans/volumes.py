"""Queries on voxel volumes and masks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.operators import volume as V
from scanframe.operators import windows as Wn
from scanframe.plans.catalog import query

r6 = lambda c: F.round(c, 6)

_BIN = "least(greatest(floor({0} * {1}), 0), {1} - 1)::INT"


@query("agg_soft_hist", "vox", "SELECT vol, bin, round(sum(w), 6) AS w FROM (SELECT vol, unnest([{{'bin': least(greatest(floor(p), 0), 31)::INT, 'w': least(greatest(floor(p) + 1 - p, 0), 1)}}, {{'bin': least(greatest(floor(p) + 1, 0), 31)::INT, 'w': least(greatest(p - floor(p), 0), 1)}}], recursive := true) FROM (SELECT vol, v / (1.0 / 31 + 1e-8) AS p FROM {vox})) GROUP BY ALL".replace("{{", "struct_pack(").replace("}}", ")").replace("'bin':", "bin :=").replace("'w':", "w :="))
def agg_soft_hist(vox):
    return V.soft_histogram(vox, ["vol"], 32).select("vol", "bin", r6("w").alias("w"))


@query("agg_soft_hist_mask", "vox", "SELECT vol, round(count(*) FILTER (WHERE label > 2), 6)::DOUBLE AS mass FROM {vox} GROUP BY vol")
def agg_soft_hist_mask(vox):
    return V.soft_histogram(vox, ["vol"], 32, mask=F.col("label") > 2).groupBy("vol").agg(r6(F.sum("w")).alias("mass"))


@query("agg_hist", "vox", "SELECT vol, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY vol), 6) AS share FROM (SELECT vol, " + _BIN.format("v", 64) + " AS bin FROM {vox}) GROUP BY vol, bin")
def agg_hist(vox):
    return V.histogram(vox, ["vol"], 64).select("vol", "bin", r6("share").alias("share"))


@query("agg_percentiles", "vox", "SELECT vol, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 1.0 / 3), 6) AS t1, round(quantile_cont(v, 2.0 / 3), 6) AS t2, round(quantile_cont(v, 0.99), 6) AS p99 FROM {vox} GROUP BY vol")
def agg_percentiles(vox):
    p = V.percentiles(vox, ["vol"], [0.01, 1 / 3, 2 / 3, 0.99])
    return p.select("vol", *[r6(F.col("p")[k]).alias(n) for k, n in enumerate(("p1", "t1", "t2", "p99"))])


_NORM = "SELECT a.*, least(greatest((v - lo) / (hi - lo), 0), 1) AS nv FROM {vox} a JOIN (SELECT vol AS w, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {vox} GROUP BY vol) ON vol = w WHERE hi > lo"


@query("norm_p1p99", "vox", f"SELECT vol, i, round(nv, 6) AS v FROM ({_NORM})")
def norm_p1p99(vox):
    return V.normalise_p1_p99(vox, ["vol"]).select("vol", "i", r6("v").alias("v"))


_FIRST = f"""WITH n AS ({_NORM}), m AS (SELECT vol, avg(nv) AS mean, stddev_pop(nv) AS std, kurtosis_pop(nv) AS kurt, quantile_cont(nv, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS p FROM n GROUP BY vol),
s AS (SELECT n.vol, avg(pow(nv - mean, 3)) / pow(any_value(std), 3) AS skew FROM n JOIN m ON n.vol = m.vol GROUP BY n.vol),
h AS (SELECT vol, -sum(q * log2(q)) AS entropy FROM (SELECT vol, count(*) / sum(count(*)) OVER (PARTITION BY vol) AS q FROM (SELECT vol, {_BIN.format("nv", 256)} AS b FROM n) GROUP BY vol, b) GROUP BY vol)
SELECT m.vol, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(p[1], 6) AS p5, round(p[2], 6) AS p10, round(p[3], 6) AS p25, round(p[4], 6) AS p50, round(p[5], 6) AS p75, round(p[6], 6) AS p90, round(p[7], 6) AS p95,
 round(entropy, 6) AS entropy, round(CASE WHEN mean > 1e-8 THEN std / mean ELSE 0 END, 6) AS cov, round(p[5] - p[3], 6) AS iqr FROM m JOIN s ON m.vol = s.vol JOIN h ON m.vol = h.vol"""


@query("agg_first_order", "vox", _FIRST)
def agg_first_order(vox):
    f = V.first_order(V.normalise_p1_p99(vox, ["vol"]), ["vol"])
    return f.select("vol", *[r6(c).alias(c) for c in f.columns[1:]])


def _radiomics(keys: str, least: int) -> str:
    return f"""WITH s AS (SELECT {keys}, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, var_pop(v) AS variance, kurtosis_pop(v) + 3 AS kurtosis, sum(v * v) AS energy, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p FROM {{vox}} GROUP BY {keys} HAVING count(*) >= {least}),
j AS (SELECT * FROM {{vox}} JOIN s USING ({keys})), r AS (SELECT {keys}, avg(v) AS rm FROM j WHERE v BETWEEN p[1] AND p[5] GROUP BY {keys}),
d AS (SELECT {keys}, avg(abs(v - mean)) AS mad, avg(abs(v - rm)) FILTER (WHERE v BETWEEN p[1] AND p[5]) AS robust_mad, avg(pow(v - mean, 3)) AS m3 FROM j JOIN r USING ({keys}) GROUP BY {keys}),
h AS (SELECT {keys}, -sum(q * log2(q)) AS entropy, sum(q * q) AS uniformity FROM (SELECT {keys}, count(*) / any_value(n) AS q FROM (SELECT *, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 64), 63) ELSE 0 END AS b FROM j) GROUP BY {keys}, b) GROUP BY {keys})
SELECT {keys}, n, round(energy, 6) AS energy, round(entropy, 6) AS entropy, round(p[1], 6) AS p10, round(p[5], 6) AS p90, round(p[3], 6) AS median, round(p[4] - p[2], 6) AS iqr, round(hi - lo, 6) AS range, round(mad, 6) AS mad, round(robust_mad, 6) AS robust_mad,
 round(sqrt(energy / n), 6) AS rms, round(m3 / pow(variance, 1.5), 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(variance, 6) AS variance, round(uniformity, 6) AS uniformity FROM s JOIN d USING ({keys}) JOIN h USING ({keys})"""


_RAD = ("energy", "entropy", "p10", "p90", "median", "iqr", "range", "mad", "robust_mad", "rms", "skewness", "kurtosis", "variance", "uniformity")


@query("agg_radiomics", "vox", _radiomics("vol", 50))
def agg_radiomics(vox):
    return V.radiomics_first_order(vox, ["vol"]).select("vol", "n", *[r6(c).alias(c) for c in _RAD])


@query("agg_radiomics_roi", "vox", f"SELECT v.vol, l.label::INT AS label, n, energy, entropy, mad, uniformity FROM (SELECT DISTINCT vol FROM {{vox}}) v CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 9]) AS label) l LEFT JOIN ({_radiomics('vol, label', 20)}) r ON r.vol = v.vol AND r.label = l.label")
def agg_radiomics_roi(vox):
    r = V.radiomics_first_order(vox, ["vol", "label"], least=20)
    out = V.with_missing_groups(r, vox, [0, 1, 2, 3, 4, 9])
    return out.select("vol", "label", "n", *[r6(c).alias(c) for c in ("energy", "entropy", "mad", "uniformity")])


@query("agg_region_mean", "vox", "SELECT vol, label, round(sum(CASE WHEN v > 0.1 THEN v ELSE 0 END) / greatest(count(*) FILTER (WHERE v > 0.1), 1), 6) AS mean FROM {vox} GROUP BY ALL")
def agg_region_mean(vox):
    return V.masked_mean(["vol", "label"], vox, F.col("v") > 0.1).select("vol", "label", r6("mean").alias("mean"))


@query("agg_class_mean", "vox", "SELECT vol, round(avg(v) FILTER (WHERE label = 1), 6) AS m1, round(avg(v) FILTER (WHERE label = 2), 6) AS m2 FROM {vox} GROUP BY vol")
def agg_class_mean(vox):
    return vox.groupBy("vol").agg(*[r6(F.avg(F.when(F.col("label") == k, F.col("v")))).alias(f"m{k}") for k in (1, 2)])


_REGION = {1: 0, 2: 1, 3: 1, 4: 2}


@query("agg_region_hist", "vox", """WITH d AS (SELECT vol, v, CASE label WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 END AS region FROM {vox} WHERE label > 0),
n AS (SELECT d.vol, region, least(greatest((v - lo) / (hi - lo), 0), 1) AS v FROM d JOIN (SELECT vol, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM d GROUP BY vol) p ON p.vol = d.vol WHERE hi > lo),
b AS (SELECT vol, region, v FROM n UNION ALL SELECT vol, 3, v FROM n), h AS (SELECT vol, region, least(floor(v * 16), 15)::INT AS bin, count(*) AS c FROM b GROUP BY ALL), s AS (SELECT vol, region, sum(c) AS t FROM h GROUP BY ALL)
SELECT g.vol, g.region::INT AS region, g.bin::INT AS bin, round(CASE WHEN coalesce(t, 0) >= 150 THEN coalesce(c, 0) / t ELSE 0 END, 6) AS share FROM (SELECT vol, region, bin FROM (SELECT DISTINCT vol FROM n), range(0, 4) a(region), range(0, 16) c(bin)) g LEFT JOIN h USING (vol, region, bin) LEFT JOIN s USING (vol, region)""")
def agg_region_hist(vox):
    d = vox.withColumn("region", V.region_of(F.col("label"), _REGION, None))
    return V.region_histogram(d, 3, 16, 150).select("vol", "region", "bin", r6("share").alias("share"))


@query("join_label_region", "vox", "SELECT vol, CASE label WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 END::INT AS region, count(*) AS n FROM {vox} GROUP BY ALL")
def join_label_region(vox):
    return vox.groupBy("vol", V.region_of(F.col("label"), _REGION, None).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_label_lut", "vox", "SELECT vol, i, CASE label WHEN 1 THEN 10 WHEN 3 THEN 30 ELSE 0 END AS class FROM {vox}")
def fn_label_lut(vox):
    return vox.select("vol", "i", V.region_of(F.col("label"), {1: 10, 3: 30}).alias("class"))


@query("agg_bbox", "vox", "SELECT vol, min(z) AS min_z, max(z) AS max_z, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM {vox} WHERE v > 0.5 GROUP BY vol")
def agg_bbox(vox):
    return V.bounding_box(vox, F.col("v") > 0.5)


@query("agg_volume_minmax", "vox", "SELECT vol, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean FROM {vox} GROUP BY vol")
def agg_volume_minmax(vox):
    return vox.groupBy("vol").agg(r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi"), r6(F.avg("v")).alias("mean"))


@query("agg_joint_hist_nmi", "vox", """WITH d AS (SELECT vol, v AS a, v * v + label * 0.1 AS b FROM {vox}), r AS (SELECT vol, min(a) a0, max(a) a1, min(b) b0, max(b) b1, count(*) n FROM d GROUP BY vol),
h AS (SELECT d.vol, CASE WHEN a1 > a0 THEN least(floor((a - a0) / (a1 - a0) * 64), 63) ELSE 32 END AS i, CASE WHEN b1 > b0 THEN least(floor((b - b0) / (b1 - b0) * 64), 63) ELSE 32 END AS j, count(*) / any_value(n) AS p FROM d JOIN r ON d.vol = r.vol GROUP BY ALL),
x AS (SELECT vol, -sum(p * ln(p + 1e-10)) AS e FROM (SELECT vol, i, sum(p) AS p FROM h GROUP BY ALL) GROUP BY vol), y AS (SELECT vol, -sum(p * ln(p + 1e-10)) AS e FROM (SELECT vol, j, sum(p) AS p FROM h GROUP BY ALL) GROUP BY vol), z AS (SELECT vol, -sum(p * ln(p + 1e-10)) AS e FROM h GROUP BY vol)
SELECT x.vol, round((x.e + y.e) / (z.e + 1e-10), 6) AS nmi FROM x JOIN y ON x.vol = y.vol JOIN z ON x.vol = z.vol""")
def agg_joint_hist_nmi(vox):
    d = vox.select("vol", F.col("v").alias("a"), (F.col("v") * F.col("v") + F.col("label") * 0.1).alias("b"))
    return V.nmi(d, ["vol"], "a", "b").select("vol", r6("nmi").alias("nmi"))


@query("agg_dice", "pairs", "SELECT case_id, round(2.0 * count(*) FILTER (WHERE pred = 1 AND truth = 1) / nullif(count(*) FILTER (WHERE pred = 1) + count(*) FILTER (WHERE truth = 1), 0), 6) AS dice FROM {pairs} GROUP BY case_id")
def agg_dice(pairs):
    return V.dice(pairs, ["case_id"], 1).select("case_id", r6("dice").alias("dice"))


@query("agg_tp_fp_fn", "pairs", "SELECT case_id, count(*) FILTER (WHERE pred = 2 AND truth = 2) AS tp, count(*) FILTER (WHERE pred = 2 AND truth <> 2) AS fp, count(*) FILTER (WHERE pred <> 2 AND truth = 2) AS fn FROM {pairs} GROUP BY case_id")
def agg_tp_fp_fn(pairs):
    return V.confusion(pairs, ["case_id"], 2)


@query("agg_vote", "lineitem", "SELECT voxel, arg_max(label, (c, -label)) AS vote FROM (SELECT l_orderkey AS voxel, l_linenumber % 3 AS label, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY voxel")
def agg_vote(lineitem):
    return V.majority_vote(lineitem.select(F.col("l_orderkey").alias("voxel"), (F.col("l_linenumber") % 3).alias("label")), ["voxel"], "label")


@query("agg_qc_counts", "vox", "SELECT vol, " + ", ".join(f"count(*) FILTER (WHERE label = {k}) AS n{k}" for k in range(1, 5)) + ", " + " AND ".join(f"count(*) FILTER (WHERE label = {k}) >= 190" for k in range(1, 5)) + " AS passed FROM {vox} GROUP BY vol")
def agg_qc_counts(vox):
    c = vox.groupBy("vol").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(1, 5)])
    return c.withColumn("passed", (F.col("n1") >= 190) & (F.col("n2") >= 190) & (F.col("n3") >= 190) & (F.col("n4") >= 190))


@query("agg_inversion", "vox", "SELECT vol, round(avg(1 - v) FILTER (WHERE v >= t[2]) - avg(1 - v) FILTER (WHERE v <= t[1]), 6) AS score FROM {vox} JOIN (SELECT vol AS w, quantile_cont(v, [1.0 / 3, 2.0 / 3]) AS t FROM {vox} GROUP BY vol) ON vol = w GROUP BY vol")
def agg_inversion(vox):
    return V.inversion_score(vox.withColumn("out", 1 - F.col("v")), ["vol"], "out").select("vol", r6("score").alias("score"))


@query("agg_label_coverage", "vox", "SELECT vol, round(avg((label > 0)::INT), 6) AS coverage, avg((label > 0)::INT) >= 0.01 AS enough FROM {vox} GROUP BY vol")
def agg_label_coverage(vox):
    share = F.avg((F.col("label") > 0).cast("int"))
    return vox.groupBy("vol").agg(r6(share).alias("coverage"), (share >= 0.01).alias("enough"))


_SURFACE = "SELECT m.vol, m.z, m.y, m.x FROM {0} m WHERE (SELECT count(*) FROM {0} o WHERE o.vol = m.vol AND abs(o.z - m.z) + abs(o.y - m.y) + abs(o.x - m.x) = 1) < 6"


@query("agg_hd95", "vox", f"""WITH p AS (SELECT vol, z, y, x FROM {{vox}} WHERE v > 0.3), t AS (SELECT vol, z, y, x FROM {{vox}} WHERE label = 2 AND v > 0.2), sp AS ({_SURFACE.format('p')}), st AS ({_SURFACE.format('t')}),
d AS (SELECT sp.vol, sp.z AS pz, sp.y AS py, sp.x AS px, st.z AS tz, st.y AS ty, st.x AS tx, sqrt((sp.z - st.z) ** 2 + (sp.y - st.y) ** 2 + (sp.x - st.x) ** 2) AS d FROM sp JOIN st ON sp.vol = st.vol)
SELECT a.vol, round(greatest(a.h, b.h), 6) AS hd95 FROM (SELECT vol, quantile_cont(m, 0.95) AS h FROM (SELECT vol, min(d) AS m FROM d GROUP BY vol, pz, py, px) GROUP BY vol) a JOIN (SELECT vol, quantile_cont(m, 0.95) AS h FROM (SELECT vol, min(d) AS m FROM d GROUP BY vol, tz, ty, tx) GROUP BY vol) b ON a.vol = b.vol""")
def agg_hd95(vox):
    p, t = V.surface(vox, F.col("v") > 0.3), V.surface(vox, (F.col("label") == 2) & (F.col("v") > 0.2))
    return V.hd95(p, t).select("vol", r6("hd95").alias("hd95"))


@query("win_cumsum_cdf", "vox", "SELECT vol, bin, round(sum(c) OVER (PARTITION BY vol ORDER BY bin) / sum(c) OVER (PARTITION BY vol), 6) AS cdf FROM (SELECT vol, " + _BIN.format("v", 64) + " AS bin, count(*) AS c FROM {vox} GROUP BY ALL)")
def win_cumsum_cdf(vox):
    return Wn.cdf(V.histogram(vox, ["vol"], 64), ["vol"], "bin", "n").select("vol", "bin", r6("cdf").alias("cdf"))


@query("win_cummax", "vox", "SELECT vol, label, round(max(m) OVER (PARTITION BY vol ORDER BY label), 6) AS edge FROM (SELECT vol, label, quantile_cont(v, 0.5) AS m FROM {vox} GROUP BY ALL)")
def win_cummax(vox):
    m = vox.groupBy("vol", "label").agg(F.percentile("v", 0.5).alias("m"))
    return Wn.running_max(m, ["vol"], "label", "m", "edge").select("vol", "label", r6("edge").alias("edge"))


_GRID = "SELECT g.vol, g.bin, coalesce(c, 0) AS c FROM (SELECT vol, b::INT AS bin FROM (SELECT DISTINCT vol FROM {vox}), range(0, 32) t(b)) g LEFT JOIN (SELECT vol, " + _BIN.format("v", 32) + " AS bin, count(*) AS c FROM {vox} GROUP BY ALL) h USING (vol, bin)"
_K7 = Wn.gaussian(3, 1.5)
_SMOOTH = "SELECT vol, bin, " + " + ".join(f"coalesce(lag(c, {-o}) OVER w, 0) * {_K7[o + 3]!r}" if o <= 0 else f"coalesce(lead(c, {o}) OVER w, 0) * {_K7[o + 3]!r}" for o in range(-3, 4)) + f" AS s FROM ({_GRID}) WINDOW w AS (PARTITION BY vol ORDER BY bin)"


def _bins(vox):
    grid = vox.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bin"))
    return grid.join(V.histogram(vox, ["vol"], 32), ["vol", "bin"], "left").select("vol", "bin", F.coalesce("n", F.lit(0)).alias("c"))


@query("win_smooth_1d", "vox", f"SELECT vol, bin, round(s, 6) AS s FROM ({_SMOOTH})")
def win_smooth_1d(vox):
    return Wn.smooth_bins(_bins(vox), ["vol"], "bin", "c", 1.5, 3, "s").select("vol", "bin", r6("s").alias("s"))


@query("win_local_max", "vox", f"SELECT vol, bin, peak FROM (SELECT vol, bin, row_number() OVER (PARTITION BY vol ORDER BY s DESC, bin)::INT AS peak FROM (SELECT vol, bin, round(s, 9) AS s, coalesce(lag(round(s, 9)) OVER w, round(s, 9)) AS l, coalesce(lead(round(s, 9)) OVER w, round(s, 9)) AS r FROM ({_SMOOTH}) WINDOW w AS (PARTITION BY vol ORDER BY bin)) WHERE s >= l AND s >= r) WHERE peak <= 4")
def win_local_max(vox):
    s = Wn.smooth_bins(_bins(vox), ["vol"], "bin", "c", 1.5, 3, "s").withColumn("s", F.round("s", 9))
    return Wn.local_peaks(s, ["vol"], "bin", "s", 4).select("vol", "bin", "peak")


def _grad(a: str) -> str:
    o = ", ".join(x for x in ("z", "y", "x") if x != a)
    w = f"OVER (PARTITION BY vol, {o} ORDER BY {a})"
    return f"CASE WHEN lag(v) {w} IS NOT NULL AND lead(v) {w} IS NOT NULL THEN (lead(v) {w} - lag(v) {w}) / 2 WHEN lead(v) {w} IS NOT NULL THEN lead(v) {w} - v WHEN lag(v) {w} IS NOT NULL THEN v - lag(v) {w} ELSE 0 END"


@query("win_gradient", "vox", f"SELECT vol, i, round({_grad('z')}, 6) AS gz, round({_grad('y')}, 6) AS gy, round({_grad('x')}, 6) AS gx FROM {{vox}}")
def win_gradient(vox):
    return Wn.gradient(vox).select("vol", "i", *[r6(c).alias(c) for c in ("gz", "gy", "gx")])


def _lines(value: str, k: list[float], source: str, a: str) -> str:
    o = ", ".join(x for x in ("z", "y", "x") if x != a)
    r = len(k) // 2
    terms = " + ".join(f"coalesce({'lag' if d <= 0 else 'lead'}({value}, {abs(d)}) OVER w, 0) * {k[d + r]!r}" for d in range(-r, r + 1))
    return f"SELECT * REPLACE ({terms} AS {value}) FROM ({source}) WINDOW w AS (PARTITION BY vol, {o} ORDER BY {a})"


def _filtered(k: list[float], source: str = "SELECT * FROM {vox}", value: str = "v") -> str:
    for a in ("z", "y", "x"):
        source = _lines(value, k, source, a)
    return source


@query("win_blur_sep", "vox", f"SELECT vol, i, round(v, 6) AS v FROM ({_filtered(Wn.gaussian(3, 1.0))})")
def win_blur_sep(vox):
    return Wn.blur(vox, 1.0).select("vol", "i", r6("v").alias("v"))


@query("blur_variants", "vox", f"SELECT vol, i, round(v, 6) AS v FROM ({_filtered(Wn.gaussian(2, 2.0))})")
def blur_variants(vox):
    return Wn.blur(vox, 2.0, radius=2).select("vol", "i", r6("v").alias("v"))


@query("win_box_mean", "vox", f"SELECT vol, i, round(v, 6) AS v FROM ({_filtered([0.2] * 5)})")
def win_box_mean(vox):
    return Wn.box_mean(vox, 5).select("vol", "i", r6("v").alias("v"))


def _diff(a: str) -> str:
    return f"abs(v - lag(v) OVER (PARTITION BY vol, {', '.join(x for x in ('z', 'y', 'x') if x != a)} ORDER BY {a}))"


@query("win_tv", "vox", f"SELECT vol, round(coalesce(avg(dz), 0) + coalesce(avg(dy), 0) + coalesce(avg(dx), 0), 6) AS tv FROM (SELECT vol, {_diff('z')} AS dz, {_diff('y')} AS dy, {_diff('x')} AS dx FROM {{vox}}) GROUP BY vol")
def win_tv(vox):
    return Wn.total_variation(vox, ["vol"]).select("vol", r6("tv").alias("tv"))


@query("mask_dual", "vox")
def mask_dual(vox):
    return V.dual_mask(vox, least=500).select("vol", "i", "mask")


@query("mask_otsu", "vox", "SELECT vol, arg_max(bin, (round(b, 6), -bin)) AS bin FROM (SELECT vol, bin, coalesce(w0 * (w - w0) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)) ** 2, 0) AS b FROM (SELECT vol, bin, sum(c) OVER o AS w0, sum(c * (bin + 0.5) / 64) OVER o AS s0, sum(c) OVER (PARTITION BY vol) AS w, sum(c * (bin + 0.5) / 64) OVER (PARTITION BY vol) AS s FROM (SELECT vol, " + _BIN.format("v", 64) + " AS bin, count(*) AS c FROM {vox} GROUP BY ALL) WINDOW o AS (PARTITION BY vol ORDER BY bin))) GROUP BY vol")
def mask_otsu(vox):
    return V.otsu(V.histogram(vox, ["vol"], 64), ["vol"], 64)


@query("mask_driver", "vox", "SELECT vol, round(avg((v > 0.001)::INT), 6) AS fill FROM {vox} WHERE vol % 3 <> 0 GROUP BY vol HAVING avg((v > 0.001)::INT) <= 0.95")
def mask_driver(vox):
    todo = vox.join(vox.where("vol % 3 = 0").select("vol").distinct(), "vol", "left_anti")
    return todo.groupBy("vol").agg(F.avg((F.col("v") > 0.001).cast("int")).alias("fill")).where("fill <= 0.95").select("vol", r6("fill").alias("fill"))


_DIRS = V.fibonacci_half_sphere(8)


@query("feat_hog3d", "vox", f"""WITH g AS (SELECT vol, z, y, x, {_grad('z')} AS gz, {_grad('y')} AS gy, {_grad('x')} AS gx FROM {{vox}}), m AS (SELECT *, sqrt(gz * gz + gy * gy + gx * gx) AS mag FROM g),
o AS (SELECT m.vol, mag, ((least(floor((z - z0) * 4 / (z1 - z0 + 1)), 3) * 4 + least(floor((y - y0) * 4 / (y1 - y0 + 1)), 3)) * 4 + least(floor((x - x0) * 4 / (x1 - x0 + 1)), 3))::INT AS cell,
 [{', '.join(f'round(abs((gz * {a!r} + gy * {b!r} + gx * {c!r}) / greatest(mag, 1e-8)), 9)' for a, b, c in _DIRS)}] AS dots FROM m JOIN (SELECT vol, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM m GROUP BY vol) b ON m.vol = b.vol),
h AS (SELECT vol, cell, (list_position(dots, list_max(dots)) - 1)::INT AS orient, sum(mag) AS w FROM o GROUP BY ALL)
SELECT vol, cell, orient, round(w / greatest(sqrt(sum(w * w) OVER (PARTITION BY vol, cell)), 1e-8), 6) AS w FROM h""")
def feat_hog3d(vox):
    return V.hog3d(vox).select("vol", "cell", "orient", r6("w").alias("w"))


@query("fn_fibonacci", "region", "SELECT unnest([" + ", ".join(f"struct_pack(k := {k}, z := {round(a, 6)!r}::DOUBLE, y := {round(b, 6)!r}::DOUBLE, x := {round(c, 6)!r}::DOUBLE)" for k, (a, b, c) in enumerate(_DIRS)) + "], recursive := true)")
def fn_fibonacci(region):
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for k, (a, b, c) in enumerate(_DIRS)])
    return region.limit(1).select(F.inline(rows)).select("k", *[F.round(c, 6).alias(c) for c in ("z", "y", "x")])


@query("feat_hist256", "vox", f"""WITH n AS ({_NORM}), g AS (SELECT vol, sqrt(pow({_grad('z')}, 2) + pow({_grad('y')}, 2) + pow({_grad('x')}, 2)) AS g FROM {{vox}}), q AS (SELECT vol, quantile_cont(g, 0.99) AS p99 FROM g GROUP BY vol)
SELECT vol, 'intensity' AS kind, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY vol), 6) AS share FROM (SELECT vol, {_BIN.format('nv', 256)} AS bin FROM n) GROUP BY vol, bin
UNION ALL SELECT vol, 'gradient', bin, round(count(*) / sum(count(*)) OVER (PARTITION BY vol), 6) FROM (SELECT g.vol, {_BIN.format('least(greatest(g / p99, 0), 1)', 256)} AS bin FROM g JOIN q ON g.vol = q.vol WHERE p99 >= 1e-8) GROUP BY vol, bin""")
def feat_hist256(vox):
    intensity = V.histogram(V.normalise_p1_p99(vox, ["vol"]), ["vol"], 256).withColumn("kind", F.lit("intensity"))
    g = Wn.gradient(vox).select("vol", F.sqrt(F.col("gz") ** 2 + F.col("gy") ** 2 + F.col("gx") ** 2).alias("g"))
    top = g.groupBy("vol").agg(F.percentile("g", 0.99).alias("p99")).where("p99 >= 1e-8")
    g = g.join(top, "vol").select("vol", F.greatest(F.lit(0.0), F.least(F.col("g") / F.col("p99"), F.lit(1.0))).alias("v"))
    both = intensity.unionByName(V.histogram(g, ["vol"], 256).withColumn("kind", F.lit("gradient")))
    return both.select("vol", "kind", "bin", r6("share").alias("share"))


@query("src_4d_to_3d", "vox", "SELECT vol, y, x, round(CASE WHEN vol % 2 = 0 THEN avg(v) FILTER (WHERE z % 3 < 2) ELSE max(v) FILTER (WHERE z = 0) END, 6) AS v FROM {vox} GROUP BY vol, y, x")
def src_4d_to_3d(vox):
    # the z axis stands for the volumes of a series; b values are 0, 50 and 1000 in turn
    b = F.element_at(F.array(F.lit(0), F.lit(50), F.lit(1000)), F.col("z") % 3 + 1)
    low = F.avg(F.when(b < 100, F.col("v")))
    return vox.groupBy("vol", "y", "x").agg(r6(F.when(F.col("vol") % 2 == 0, low).otherwise(F.max(F.when(F.col("z") == 0, F.col("v"))))).alias("v"))


@query("join_segmentation_resample", "vox", "SELECT a.vol, a.i, b.label FROM {vox} a JOIN {vox} b ON b.vol = a.vol AND b.z = floor((a.z + 0.5) * 0.5) AND b.y = floor((a.y + 0.5) * 0.5) AND b.x = floor((a.x + 0.5) * 0.5)")
def join_segmentation_resample(vox):
    near = lambda a: F.floor((F.col(a) + 0.5) * 0.5).cast("int")
    seg = vox.select("vol", F.col("z").alias("sz"), F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("label").alias("seg"))
    return vox.select("vol", "i", near("z").alias("sz"), near("y").alias("sy"), near("x").alias("sx")).join(seg, ["vol", "sz", "sy", "sx"]).select("vol", "i", F.col("seg").alias("label"))


@query("target_align", "vox", "SELECT a.vol, a.i, coalesce(b.label, 0) AS label FROM {vox} a LEFT JOIN (SELECT * FROM {vox} WHERE vol % 2 = 0) b ON b.vol = a.vol AND b.z = a.z // 2 AND b.y = a.y // 2 AND b.x = a.x // 2")
def target_align(vox):
    half = lambda a: F.floor(F.col(a) / 2).cast("int")
    seg = vox.where("vol % 2 = 0").select("vol", F.col("z").alias("sz"), F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("label").alias("seg"))
    return vox.select("vol", "i", half("z").alias("sz"), half("y").alias("sy"), half("x").alias("sx")).join(seg, ["vol", "sz", "sy", "sx"], "left").select("vol", "i", F.coalesce("seg", F.lit(0)).alias("label"))


@query("target_prepare", "vox", "SELECT vol, i, (label > 0)::INT AS binary, least(greatest(label, 0), 2) AS clamped FROM {vox}")
def target_prepare(vox):
    return vox.select("vol", "i", (F.col("label") > 0).cast("int").alias("binary"), F.least(F.greatest("label", F.lit(0)), F.lit(2)).alias("clamped"))


@query("fn_binarise_label", "vox", "SELECT vol, i, (round_even(v * 4, 0) > 0)::INT AS label FROM {vox}")
def fn_binarise_label(vox):
    whole = F.rint(F.col("v") * 4)
    return vox.select("vol", "i", F.when(whole < 0, F.raise_error(F.lit("negative label")).cast("int")).otherwise((whole > 0).cast("int")).alias("label"))


@query("fn_thick_axis", "vox", "SELECT vol, i, CASE vol % 3 WHEN 0 THEN z WHEN 1 THEN y ELSE x END AS z, CASE vol % 3 WHEN 0 THEN y ELSE z END AS y, CASE vol % 3 WHEN 2 THEN y ELSE x END AS x FROM {vox}")
def fn_thick_axis(vox):
    spacing = F.array(*[F.when(F.col("vol") % 3 == k, 3.0).otherwise(1.0) for k in range(3)])
    k = F.array_position(spacing, F.array_max(spacing)) - 1  # the thickest axis comes first, the others keep their order
    first = F.when(k == 0, F.col("z")).when(k == 1, F.col("y")).otherwise(F.col("x"))
    second = F.when(k == 0, F.col("y")).otherwise(F.col("z"))
    return vox.select("vol", "i", first.alias("z"), second.alias("y"), F.when(k == 2, F.col("y")).otherwise(F.col("x")).alias("x"))


@query("fn_pad_crop", "vox", "SELECT vol, i, z + (15 - 11) // 2 AS z, y - (11 - 7) // 2 AS y, x FROM {vox} WHERE y - (11 - 7) // 2 BETWEEN 0 AND 6")
def fn_pad_crop(vox):
    from scanframe.operators.remap import centre

    return centre(vox, {"z": (11, 15), "y": (11, 7)}).select("vol", "i", "z", "y", "x")


@query("zscore_labelled", "vox", "SELECT vol, i, round(CASE WHEN label > 0 THEN (v - m) / (s + 1e-7) ELSE 0 END, 6) AS z FROM {vox} JOIN (SELECT vol AS w, avg(v) AS m, stddev_pop(v) AS s FROM {vox} WHERE label > 0 GROUP BY vol) ON vol = w")
def zscore_labelled(vox):
    s = vox.where("label > 0").groupBy("vol").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return vox.join(s, "vol").select("vol", "i", r6(F.when(F.col("label") > 0, (F.col("v") - F.col("m")) / (F.col("s") + 1e-7)).otherwise(0.0)).alias("z"))


_PT = "SELECT vol, z, y, x, v AS p, v * v + label * 0.05 AS t FROM {vox}"


def _pt(vox):
    return vox.withColumn("t", F.col("v") * F.col("v") + F.col("label") * 0.05)


@query("loss_guidance", "vox", "SELECT vol, round(avg(abs(d)), 6) AS loss FROM (" + _filtered(Wn.gaussian(2, 2.0), f"SELECT vol, z, y, x, p - t AS d FROM ({_PT})", "d") + ") GROUP BY vol")
def loss_guidance(vox):
    from scanframe.operators.losses import guidance

    return guidance(_pt(vox), "v", "t").select("vol", r6("loss").alias("loss"))


@query("loss_tv", "vox", f"SELECT vol, round(coalesce(avg(dz), 0) + coalesce(avg(dy), 0) + coalesce(avg(dx), 0), 6) AS tv FROM (SELECT vol, {_diff('z')} AS dz, {_diff('y')} AS dy, {_diff('x')} AS dx FROM (SELECT vol, z, y, x, t AS v FROM ({_PT}))) GROUP BY vol")
def loss_tv(vox):
    return Wn.total_variation(_pt(vox), ["vol"], "t").select("vol", r6("tv").alias("tv"))


@query("loss_range", "vox", "SELECT vol, round(avg(greatest(-1 - s, 0) + greatest(s - 1, 0)), 6) AS loss FROM (SELECT vol, v * 4 - 2 AS s FROM {vox}) GROUP BY vol")
def loss_range(vox):
    from scanframe.operators.losses import value_range

    return value_range(vox.withColumn("s", F.col("v") * 4 - 2), "s").select("vol", r6("loss").alias("loss"))


@query("loss_wasserstein", "vox", f"""WITH g AS ({_GRID}), h AS (SELECT vol, bin, c AS a, coalesce(lead(c) OVER (PARTITION BY vol ORDER BY bin), 0) AS b FROM g),
p AS (SELECT vol, bin, a / greatest(sum(a) OVER (PARTITION BY vol), 1e-8) AS a, b / greatest(sum(b) OVER (PARTITION BY vol), 1e-8) AS b, 1 AS part FROM h UNION ALL SELECT vol, bin, a / greatest(sum(a) OVER (PARTITION BY vol), 1e-8), b / greatest(sum(b) OVER (PARTITION BY vol), 1e-8), 2 FROM h WHERE bin >= 1),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM p WINDOW w AS (PARTITION BY vol, part ORDER BY bin))
SELECT vol, round(sum(l), 6) AS loss FROM (SELECT vol, part, avg(abs(a - b)) * 200 + avg(abs(ca - cb)) AS l FROM c GROUP BY vol, part) GROUP BY vol""")
def loss_wasserstein(vox):
    from scanframe.operators.losses import wasserstein

    h = _bins(vox).withColumnRenamed("c", "a").withColumn("b", F.coalesce(F.lead("a").over(W.partitionBy("vol").orderBy("bin")), F.lit(0)))
    return wasserstein(h, 32).select("vol", r6("loss").alias("loss"))


def _std(v: str) -> str:
    a, b = (_filtered([0.2] * 5, s, "m") for s in (f"SELECT vol, z, y, x, {v} AS m FROM ({_PT})", f"SELECT vol, z, y, x, {v} * {v} AS m FROM ({_PT})"))
    return f"SELECT a.vol, a.z, a.y, a.x, sqrt(greatest(b.m - a.m * a.m, 0) + 1e-8) AS s FROM ({a}) a JOIN ({b}) b USING (vol, z, y, x)"


@query("loss_local_var", "vox", f"SELECT vol, round(avg(abs(p.s - t.s)), 6) AS loss FROM ({_std('p')}) p JOIN ({_std('t')}) t USING (vol, z, y, x) GROUP BY vol")
def loss_local_var(vox):
    from scanframe.operators.losses import local_variance

    return local_variance(_pt(vox), "v", "t").select("vol", r6("loss").alias("loss"))


def _sobel(v: str, source: str) -> str:
    parts = []
    for a in ("z", "y", "x"):
        s = f"SELECT vol, z, y, x, {v} AS g FROM ({source})"
        for b in ("z", "y", "x"):
            s = _lines("g", [-1.0, 0.0, 1.0] if a == b else [1.0, 2.0, 1.0], s, b)
        parts.append(f"({s}) s{a}")
    return f"SELECT vol, z, y, x, sqrt(sz.g * sz.g + sy.g * sy.g + sx.g * sx.g + 1e-6) AS m FROM {parts[0]} JOIN {parts[1]} USING (vol, z, y, x) JOIN {parts[2]} USING (vol, z, y, x)"


@query("loss_dice_edge", "vox", f"""WITH p AS ({_sobel('p', _PT)}), t AS ({_sobel('t', _PT)}), e AS (SELECT vol, 1 / (1 + exp(-12 * (p.m - 0.05))) AS a, 1 / (1 + exp(-12 * (t.m - 0.05))) AS b FROM p JOIN t USING (vol, z, y, x))
SELECT vol, round(avg(abs(a - b)) + 1 - (2 * sum(a * b) + 1e-6) / (sum(a) + sum(b) + 1e-6), 6) AS loss FROM e GROUP BY vol""")
def loss_dice_edge(vox):
    from scanframe.operators.losses import dice_edge

    return dice_edge(_pt(vox), "v", "t").select("vol", r6("loss").alias("loss"))


@query("loss_ms_grad", "vox")
def loss_ms_grad(vox):
    from scanframe.operators.losses import multi_scale_gradient

    return multi_scale_gradient(_pt(vox), "v", "t").select("vol", r6("loss").alias("loss"))


@query("loss_consistency", "lineitem", "SELECT l_linenumber, round(avg(p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q))), 6) AS kl FROM (SELECT l_linenumber, 0.1 + l_discount * 5 AS p, 0.2 + l_tax * 5 AS q FROM lineitem) GROUP BY 1")
def loss_consistency(lineitem):
    from scanframe.operators.losses import bernoulli_kl

    d = lineitem.select("l_linenumber", (0.1 + F.col("l_discount") * 5).alias("p"), (0.2 + F.col("l_tax") * 5).alias("q"))
    return d.groupBy("l_linenumber").agg(r6(F.avg(bernoulli_kl(F.col("p"), F.col("q")))).alias("kl"))


@query("loss_total", "vox", f"SELECT vol, round(2 * tv + 0.5 * r, 6) AS loss FROM (SELECT vol, coalesce(avg(dz), 0) + coalesce(avg(dy), 0) + coalesce(avg(dx), 0) AS tv FROM (SELECT vol, {_diff('z')} AS dz, {_diff('y')} AS dy, {_diff('x')} AS dx FROM {{vox}}) GROUP BY vol) JOIN (SELECT vol, avg(greatest(-v, 0) + greatest(v - 0.5, 0)) AS r FROM {{vox}} GROUP BY vol) USING (vol)")
def loss_total(vox):
    from scanframe.operators.losses import total, value_range

    tv = Wn.total_variation(vox, ["vol"]).withColumnRenamed("tv", "loss")
    return total({2.0: tv, 0.5: value_range(vox, "v", 0.0, 0.5)}).select("vol", r6("loss").alias("loss"))
