"""Queries on intensity remaps and target generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanframe.functions import rng
from scanframe.operators import remap as R
from scanframe.operators import windows as Wn
from scanframe.plans.catalog import query
from scanframe.plans.volumes import _filtered

r6 = lambda c: F.round(c, 6)


def u(tag: str, *ids: str, seed: int = 42) -> str:
    """The same draw in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{tag}'{''.join(f', ({i})::VARCHAR' for i in ids)})), 1, 8))::UBIGINT / 4294967296.0)"


def pick(options, tag: str, *ids: str, seed: int = 42) -> str:
    return f"([{', '.join(map(str, options))}])[floor({u(tag, *ids, seed=seed)} * {len(options)})::INT + 1]"


def normal(tag: str, *ids: str, seed: int = 42) -> str:
    return f"(sqrt(-2 * ln(greatest({u(tag + 'a', *ids, seed=seed)}, pow(2, -33)))) * cos(2 * pi() * {u(tag + 'b', *ids, seed=seed)}))"


def _signed(tag: str, *ids: str, seed: int = 42) -> str:
    return f"((0.5 + 1.5 * {u(tag, *ids, seed=seed)}) * CASE WHEN {u(tag + 's', *ids, seed=seed)} > 0.5 THEN 1 ELSE -1 END)"


FG = "v > 0.01"


def minmax(source: str) -> str:
    """source has vol, i, v, g."""
    return f"""SELECT s.vol, i, v, CASE WHEN {FG} THEN (g - lo) / (hi - lo + 1e-6) ELSE 0 END AS g FROM ({source}) s
JOIN (SELECT vol, min(CASE WHEN {FG} THEN g ELSE 0 END) AS lo, max(CASE WHEN {FG} THEN g ELSE 0 END) AS hi FROM ({source}) GROUP BY vol) m ON s.vol = m.vol"""


def affine(source: str, mu: str, alpha: str) -> str:
    """source has vol, i, v, region."""
    return f"""SELECT s.vol, i, v, CASE WHEN {FG} THEN {mu} + {alpha} * (v - m) ELSE 0 END AS g FROM ({source}) s
JOIN (SELECT vol AS mv, region AS mr, sum(CASE WHEN {FG} THEN v ELSE 0 END) / greatest(count(*) FILTER (WHERE {FG}), 1) AS m FROM ({source}) GROUP BY vol, region) q ON s.vol = mv AND s.region = mr"""


def edges(ks: list[int], how: str, seed: int = 42, dark: float = 0.01) -> str:
    """vol, k, e (edges)."""
    k = pick(ks, "K", "vol", seed=seed)
    if how == "uniform":
        return f"SELECT vol, k, list_transform(range(0, k + 1), lambda j: j / k) AS e FROM (SELECT DISTINCT vol, {k} AS k FROM {{vox}})"
    case = " ".join(f"WHEN {n} THEN list_concat([0.0], quantile_cont(v, [{', '.join(f'{j} / {n}.0' for j in range(1, n))}]) FILTER (WHERE v > {dark}), [1.0])" for n in sorted(set(ks)))
    return f"SELECT vol, any_value(k) AS k, CASE WHEN count(*) FILTER (WHERE v > {dark}) > any_value(k) THEN CASE any_value(k) {case} END END AS e FROM (SELECT vol, v, {k} AS k FROM {{vox}}) GROUP BY vol"


def chunks(ks: list[int], how: str, seed: int = 42, dark: float = 0.01) -> str:
    """vol, i, v, k, e, region."""
    even = "list_transform(range(0, k + 1), lambda j: j / k)"
    return f"SELECT *, greatest(0, least(len(list_filter(e, lambda b: b < v)) - 1, len(e) - 2))::INT AS region FROM (SELECT a.vol, i, v, k, coalesce(e, {even}) AS e FROM {{vox}} a JOIN ({edges(ks, how, seed, dark)}) d ON a.vol = d.vol)"


def levels(ks: list[int], how: str, mu: str | None = None, alpha: str | None = None, seed: int = 42, dark: float = 0.01) -> str:
    """vol, i, v, g: chunks remapped about their middles and clamped."""
    mu = mu or u("mu", "vol", "region", seed=seed)
    alpha = alpha or f"(0.5 + 1.5 * {u('alpha', 'vol', 'region', seed=seed)})"
    return f"SELECT vol, i, v, CASE WHEN v > {dark} THEN least(greatest({mu} + {alpha} * (v - (e[region + 1] + e[region + 2]) / 2), 0), 1) ELSE 0 END AS g FROM ({chunks(ks, how, seed, dark)})"


def out(body: str) -> str:
    return f"SELECT vol, i, round(g, 6) AS g FROM ({body})"


def show(d):
    return d.select("vol", "i", r6("g").alias("g"))


_K7 = [2, 3, 4, 6, 8, 12, 16]
_MU, _AL = u("mu", "s.vol", "s.region"), f"(0.5 + 1.5 * {u('alpha', 's.vol', 's.region')})"


def _ranges(*pairs: tuple[float, float]) -> str:
    return "CASE region " + " ".join(f"WHEN {k} THEN {lo} + {hi - lo!r} * {u('mu', 'vol', str(k))}" for k, (lo, hi) in enumerate(pairs)) + " END"


@query("tg_v23_random_k", "vox", out(levels(_K7, "uniform")))
def tg_v23_random_k(vox):
    return show(R.generate(vox, "v23"))


@query("tg_v24_fg_quantile", "vox", out(levels(_K7, "quantile", dark=0.02)))
def tg_v24_fg_quantile(vox):
    return show(R.generate(vox, "v24"))


@query("tg_v24_t2w", "vox", out(levels([3], "quantile", _ranges((0.6, 1.0), (0.2, 0.8), (0.0, 0.4)), dark=0.02)))
def tg_v24_t2w(vox):
    return show(R.generate(vox, "v24_t2w"))


@query("tg_v24_pdw", "vox", out(levels([3], "quantile", _ranges((0.02, 0.08), (0.55, 0.65), (0.40, 0.50)), f"(1.2 + 0.6 * {u('alpha', 'vol', 'region')})", dark=0.02)))
def tg_v24_pdw(vox):
    return show(R.generate(vox, "v24_pdw"))


@query("tg_v24_desc", "vox", out(levels([2, 3, 4], "quantile", f"(list_reverse_sort(list_transform(range(0, k), lambda j: {u('mu', 'vol', 'j')})))[region + 1]", dark=0.02)))
def tg_v24_desc(vox):
    return show(R.generate(vox, "v24_desc"))


@query("tg_v24_inv", "vox", f"SELECT vol, i, round(CASE WHEN v <= 0.02 THEN 0 WHEN {u('inv', 'vol')} > 0.5 THEN least(greatest(1 - v, 0), 1) ELSE g END, 6) AS g FROM ({levels(_K7, 'quantile', dark=0.02)})")
def tg_v24_inv(vox):
    return show(R.generate(vox, "v24_inv"))


_SWAP = "[" + ", ".join(f"{k} / 8.0" for k in range(9)) + "]"


@query("tg_legacy", "vox", f"""WITH q AS (SELECT vol AS w, quantile_cont(v, {_SWAP}) AS q FROM {{vox}} WHERE {FG} GROUP BY vol), e AS (SELECT w, list_concat([least(q[1], 0.01)], q[2:8], [greatest(q[9], 1.0)]) AS e, list_transform(list_sort([{', '.join(f"struct_pack(u := {u('mu', 'w', str(k))}, j := {k})" for k in range(8))}]), lambda x: x.j) AS t FROM q),
r AS (SELECT vol, i, v, e, t, greatest(0, least(len(list_filter(e, lambda b: b < v)) - 1, 7))::INT AS r FROM {{vox}} JOIN e ON vol = w)
SELECT vol, i, round(CASE WHEN {FG} THEN least(greatest(e[t[r + 1] + 1] + (v - e[r + 1]) / greatest(e[r + 2] - e[r + 1], 1e-8) * (e[t[r + 1] + 2] - e[t[r + 1] + 1]), 0), 1) ELSE v END, 6) AS g FROM r""")
def tg_legacy(vox):
    return show(R.generate(vox, "legacy"))


@query("dispatch_targets", "vox", f"SELECT vol, round(avg(g), 6) AS mean FROM ({levels(_K7, 'uniform')}) GROUP BY vol")
def dispatch_targets(vox):
    return R.generate(vox, "v23").groupBy("vol").agg(r6(F.avg("g")).alias("mean"))


def _between(lo: float, hi: float, tag: str) -> str:
    return f"({lo} + {hi - lo!r} * {u(tag, 'vol')})"


def _knots(places: str) -> str:
    """places: vol, n, x1, x2, x3, top, dip of each volume."""
    return f"""SELECT vol, i, round(CASE WHEN v <= 0.02 OR n < 100 OR n IS NULL OR v < x1 THEN 0 ELSE least(greatest(CASE WHEN v < x2 THEN (v - x1) / (x2 - x1) * top WHEN v < x3 THEN top + (v - x2) / (x3 - x2) * (dip - top)
 ELSE dip + (v - x3) / greatest(1 - x3, 1e-4) * (1 - dip) END, 0), 1) END, 6) AS g FROM {{vox}} LEFT JOIN ({places}) ON vol = w"""


@query("tg_v24_nm", "vox", _knots(f"SELECT vol AS w, 100 AS n, {_between(0.05, 0.15, 'x1')} AS x1, {_between(0.30, 0.50, 'x2')} AS x2, {_between(0.60, 0.80, 'x3')} AS x3, {_between(0.65, 0.80, 'top')} AS top, {_between(0.45, 0.62, 'dip')} AS dip FROM (SELECT DISTINCT vol FROM {{vox}})"))
def tg_v24_nm(vox):
    return show(R.generate(vox, "v24_nm"))


_RANK = "s[least(floor({0} * len(s))::INT, len(s) - 1) + 1]"


@query("tg_v24_nm2", "vox", _knots(f"""SELECT vol AS w, len(s) AS n, 0.02 AS x1, {_RANK.format(_between(0.55, 0.75, 'q2'))} AS x2,
 CASE WHEN {_RANK.format(_between(0.55, 0.75, 'q2'))} >= {_RANK.format(_between(0.75, 0.90, 'q3'))} THEN {_RANK.format(_between(0.55, 0.75, 'q2'))} + 1e-4 ELSE {_RANK.format(_between(0.75, 0.90, 'q3'))} END AS x3,
 {_between(0.68, 0.80, 'top')} AS top, {_between(0.50, 0.70, 'ratio')} * {_between(0.68, 0.80, 'top')} AS dip FROM (SELECT vol, list_sort(list(v)) AS s FROM {{vox}} WHERE v > 0.02 GROUP BY vol)"""))
def tg_v24_nm2(vox):
    return show(R.generate(vox, "v24_nm2"))


def _interp(x: str, xs: list[str], ys: list[str]) -> str:
    body = " ".join(f"WHEN {x} <= {xs[k]} THEN {ys[k - 1]} + coalesce(({x} - {xs[k - 1]}) / nullif({xs[k]} - {xs[k - 1]}, 0), 0) * ({ys[k]} - {ys[k - 1]})" for k in range(1, len(xs)))
    return f"CASE WHEN {x} <= {xs[0]} THEN {ys[0]} {body} ELSE {ys[-1]} END"


@query("fn_interp1d", "vox", f"SELECT vol, i, round({_interp('v', ['0.0', '0.2', '0.9'], ['0.5', '1.0', '0.0'])}, 6) AS g FROM {{vox}}")
def fn_interp1d(vox):
    return show(vox.withColumn("g", R.interp(F.col("v"), [F.lit(x) for x in (0.0, 0.2, 0.9)], [F.lit(x) for x in (0.5, 1.0, 0.0)])))


@query("fn_bezier", "vox", f"SELECT vol, i, round(CASE WHEN {u('bz', 'vol')} < 0.5 THEN 3 * (1 - v) * (1 - v) * v * {u('b1', 'vol')} + 3 * (1 - v) * v * v * {u('b2', 'vol')} + v * v * v ELSE v END, 6) AS g FROM {{vox}}")
def fn_bezier(vox):
    return show(vox.withColumn("g", R.bezier(F.col("v"), 42)))


@query("fn_clamp", "vox", "SELECT vol, i, round(least(greatest(v * 4 - 1, 0), 1), 6) AS g FROM {vox}")
def fn_clamp(vox):
    return show(vox.withColumn("g", R.clamp01(F.col("v") * 4 - 1)))


@query("fn_minmax", "vox", out(minmax("SELECT vol, i, v, v * 3 - 0.5 AS g FROM {vox}")))
def fn_minmax(vox):
    return show(R.minmax(vox.withColumn("g", F.col("v") * 3 - 0.5)))


@query("fn_zscore_fg", "vox", f"SELECT vol, i, round(CASE WHEN {FG} THEN (v - m) / sqrt(s + 1e-7) ELSE 0 END, 6) AS g FROM {{vox}} JOIN (SELECT vol AS w, avg(v) AS m, var_pop(v) AS s FROM {{vox}} WHERE {FG} GROUP BY vol) ON vol = w")
def fn_zscore_fg(vox):
    return show(R.zscore_foreground(vox.withColumn("g", F.col("v")), "g"))


@query("fg_filter", "vox", f"SELECT vol, count(*) AS n FROM {{vox}} WHERE {FG} GROUP BY vol")
def fg_filter(vox):
    return vox.where(R.foreground()).groupBy("vol").agg(F.count(F.lit(1)).alias("n"))


@query("join_range_bucket", "vox", "SELECT vol, greatest(0, least((v > 0)::INT + (v > 0.1)::INT + (v > 0.4)::INT + (v > 1)::INT - 1, 2)) AS bin, count(*) AS n FROM {vox} GROUP BY ALL")
def join_range_bucket(vox):
    return vox.groupBy("vol", R.chunk_of(F.col("v"), F.array(*map(F.lit, (0.0, 0.1, 0.4, 1.0)))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("join_region_params", "vox", f"SELECT vol, i, round(CASE WHEN {FG} THEN {u('mu', 'vol', 'label')} + (0.5 + 1.5 * {u('alpha', 'vol', 'label')}) * (v - m) ELSE 0 END, 6) AS g FROM {{vox}} JOIN (SELECT vol AS w, label AS l, avg(v) FILTER (WHERE {FG}) AS m FROM {{vox}} GROUP BY ALL) ON vol = w AND label = l")
def join_region_params(vox):
    d = vox.withColumn("region", F.col("label"))
    return show(R.affine_by_region(d, rng.uniform(42, "mu", "vol", "region"), rng.between(0.5, 2.0, 42, "alpha", "vol", "region")))


def _kmeans(cs, seed: int = 42) -> str:
    """CTEs k0 .. k10 with vol, c, j, m (centroid j)."""
    s = f"""smp AS (SELECT vol, v, {pick(cs, 'C', 'vol', seed=seed)} AS c FROM (SELECT vol, i, v, row_number() OVER (PARTITION BY vol ORDER BY md5(concat_ws(':', '{seed}', 'km', vol::VARCHAR, i::VARCHAR)), vol, i) AS n FROM {{vox}} WHERE {FG}) WHERE n <= 10000),
k0 AS (SELECT vol, c, j, lo + (hi - lo) * j / greatest(c - 1, 1) AS m FROM (SELECT vol, any_value(c) AS c, min(v) AS lo, max(v) AS hi FROM smp GROUP BY vol), LATERAL (SELECT unnest(range(0, c)) AS j))"""
    for n in range(1, 11):
        s += f""",
k{n} AS (SELECT k.vol, k.c, k.j, coalesce(a.m, k.m) AS m FROM k{n - 1} k LEFT JOIN (SELECT vol, j, avg(v) AS m FROM (SELECT s.vol, s.v, s.rid, arg_min(k.j, (abs(s.v - k.m), k.j)) AS j FROM (SELECT *, row_number() OVER () AS rid FROM smp) s JOIN k{n - 1} k ON s.vol = k.vol GROUP BY s.vol, s.v, s.rid) GROUP BY vol, j) a ON a.vol = k.vol AND a.j = k.j)"""
    return s


@query("kmeans_1d", "vox", f"WITH {_kmeans([2, 3, 4, 5, 6])} SELECT vol, j::INT AS j, round(m, 6) AS m FROM k10")
def kmeans_1d(vox):
    k = R.kmeans_1d(vox, [2, 3, 4, 5, 6], 42)
    return k.select("vol", F.posexplode("centroids").alias("j", "m")).withColumn("m", r6("m"))


@query("centroids_once", "vox", f"WITH {_kmeans([4])} SELECT vol, count(*) AS n, round(sum(m), 6) AS total FROM k10 GROUP BY vol")
def centroids_once(vox):
    k = R.kmeans_1d(vox, [4], 42)
    return k.select("vol", F.size("centroids").cast("long").alias("n"), r6(F.aggregate("centroids", F.lit(0.0), lambda a, x: a + x)).alias("total"))


#: What the generators draw, written down from their description and apart from the operators' table: numbers of clusters, whether
#: clusters are cut into cells, chances of one region and of whole clusters, signed slopes, levels, chance of flat clusters, range.
_FEW, _MANY, _CELLS = [2, 3, 4, 5, 6], [8, 10, 12, 16], list(range(2, 11))
_AS_DESCRIBED = {
    "v26_1": dict(cs=_FEW, cells=True, one=0.0, uncut=0.0, signed=False, level="region", flat=0.0, scaled=False),
    "v26_2": dict(cs=_FEW, cells=True, one=0.3, uncut=0.4, signed=False, level="region", flat=0.0, scaled=False),
    "v26_3": dict(cs=_FEW, cells=True, one=0.1, uncut=0.4, signed=False, level="region", flat=0.0, scaled=True),
    "v26_4": dict(cs=_FEW, cells=True, one=0.1, uncut=0.4, signed=False, level="region", flat=0.0, scaled=True),
    "v26_5": dict(cs=_FEW, cells=True, one=0.1, uncut=0.4, signed=False, level="polar", flat=0.0, scaled=True),
    "v26_6": dict(cs=_FEW, cells=True, one=0.1, uncut=0.4, signed=True, level="region", flat=0.0, scaled=True),
    "v26_7": dict(cs=_FEW, cells=True, one=0.1, uncut=0.4, signed=True, level="region", flat=1.0, scaled=True),
    "v26_11": dict(cs=_MANY, cells=False, one=0.05, uncut=0.4, signed=True, level="region", flat=0.0, scaled=True),
    "v26_12": dict(cs=_FEW, cells=True, one=0.05, uncut=0.4, signed=True, level="bands", flat=0.0, scaled=True),
    "v26_13": dict(cs=_MANY, cells=False, one=0.05, uncut=0.4, signed=True, level="bands", flat=0.0, scaled=True),
    "v26_14": dict(cs=_FEW, cells=True, one=0.05, uncut=0.4, signed=True, level="class", flat=0.4, scaled=True),
    "raw": dict(cs=_FEW, cells=True, one=0.1, uncut=0.4, signed=True, level="region", flat=0.0, scaled=False),
}
_AFTER = {"v26_8": "invert", "v26_9": "gamma", "v26_10": "texture", "v28_1": "rician", "v28_2": "", "v28_3": "dropout", "v28_4": "dropout"}


def _parcels(o: dict, seed: int = 42, source: str = "{vox}", whole: str | None = None) -> str:
    """CTEs up to reg: vol, i, v, z, y, x, c, one, klass, region. whole: where the clusters come from, if not from source."""
    cl = "vol, cluster"
    s = f"""WITH {_kmeans(o['cs'], seed).replace('{vox}', whole or '{vox}')},
cent AS (SELECT vol AS cv, any_value(c) AS c, list(m ORDER BY j) AS ms FROM k10 GROUP BY vol),
clu AS (SELECT vol, i, z, y, x, v, label, c, len(list_filter(range(1, len(ms)), lambda q: (ms[q] + ms[q + 1]) / 2 < v))::INT AS cluster FROM {{vox}} JOIN cent ON vol = cv)"""
    if o["cells"]:
        s += f""",
seeds AS (SELECT {cl}, i AS si, z AS sz, y AS sy, x AS sx FROM (SELECT *, row_number() OVER (PARTITION BY {cl} ORDER BY md5(concat_ws(':', '{seed}', 'seed', vol::VARCHAR, i::VARCHAR)), vol, i) AS n, {pick(_CELLS, 'S', 'vol', 'cluster', seed=seed)} AS s FROM clu WHERE {FG}) WHERE n <= s),
sn AS (SELECT *, row_number() OVER (PARTITION BY {cl} ORDER BY si) - 1 AS k, count(*) OVER (PARTITION BY {cl}) AS many FROM seeds),
near AS (SELECT a.vol, a.i, arg_min(k, ((a.z - sz) ** 2 + (a.y - sy) ** 2 + (a.x - sx) ** 2, k)) AS cell, any_value(many) AS many FROM clu a JOIN sn ON sn.vol = a.vol AND sn.cluster = a.cluster GROUP BY a.vol, a.i),
cel AS (SELECT clu.*, CASE WHEN {u('skip', 'clu.vol', 'clu.cluster', seed=seed)} < {o['uncut']} OR many IS NULL OR many < 2 THEN 0 ELSE cell END AS cell FROM clu LEFT JOIN near ON near.vol = clu.vol AND near.i = clu.i)"""
    else:
        s += ",\ncel AS (SELECT *, 0 AS cell FROM clu)"
    s += f""",
reg AS (SELECT *, CASE WHEN one THEN 0 ELSE cluster END AS klass, CASE WHEN one THEN 0 ELSE (cluster * 100 + cell)::INT END AS region FROM (SELECT *, {u('all', 'vol', seed=seed)} < {o['one']} AS one FROM cel))"""
    return s.replace("{vox}", source).replace("{all}", "{vox}")


def _remap_sql(o: dict, seed: int = 42, source: str = "{vox}", whole: str | None = None) -> str:
    """vol, i, v, g of every voxel."""
    klass = u("mu", "s.vol", "s.klass", seed=seed)
    level = {"region": u("mu", "s.vol", "s.region", seed=seed), "class": klass}.get(o["level"])
    if o["level"] == "polar":
        level = f"CASE WHEN NOT one AND {u('anti', 's.vol', seed=seed)} < 0.5 THEN (list_reverse_sort(list_transform(range(0, c), lambda q: {u('mu', 's.vol', 'q', seed=seed)})))[klass + 1] ELSE {klass} END"
    elif o["level"] == "bands":
        level = f"CASE WHEN one THEN {klass} ELSE ((list_sort(list_transform(range(0, c), lambda q: {{'u': {u('band', 's.vol', 'q', seed=seed)}, 'q': q}})))[klass + 1].q + {klass}) / c END"
    slope = _signed("alpha", "s.vol", "s.region", seed=seed) if o["signed"] else f"(0.5 + 1.5 * {u('alpha', 's.vol', 's.region', seed=seed)})"
    if o["flat"]:
        slope = f"CASE WHEN {u('const', 's.vol', 's.klass', seed=seed)} < {o['flat']}{'' if o['flat'] >= 1 else ' AND NOT one'} THEN 0 ELSE {slope} END"
    body = affine("SELECT * FROM reg", f"({level})", f"({slope})")
    return f"{_parcels(o, seed, source, whole)}\n{minmax(body) if o['scaled'] else body}"


def _places(body: str, value: str = "g") -> str:
    """body (vol, i, v, g) with the voxels' places and labels."""
    return f"SELECT a.vol, a.i, b.z, b.y, b.x, b.label, a.v, a.g FROM ({body}) a JOIN {{vox}} b ON a.vol = b.vol AND a.i = b.i"


def _lerp(scale: int) -> str:
    at = lambda a: f"floor({a} / {scale}.0)"
    part = lambda a: f"({a} / {scale}.0 - floor({a} / {scale}.0))"
    corners = []
    for corner in range(8):
        w, ids = [], []
        for k, a in enumerate(("z", "y", "x")):
            high = corner >> k & 1
            w.append(part(a) if high else f"(1 - {part(a)})")
            ids.append(f"({at(a)}::BIGINT + {high})")
        corners.append(f"{' * '.join(w)} * {normal(f'f{scale}', 'vol', *ids)}")
    return f"({' + '.join(corners)})"


def _texture(source: str) -> str:
    """source's columns and noise in [-0.5, 0.5]."""
    total = " + ".join(f"{_lerp(s)} / {s}" for s in (2, 4, 8, 16))
    return f"SELECT * EXCLUDE (noise), (noise - min(noise) OVER (PARTITION BY vol)) / (max(noise) OVER (PARTITION BY vol) - min(noise) OVER (PARTITION BY vol) + 1e-6) - 0.5 AS noise FROM (SELECT *, {total} AS noise FROM ({source}))"


def _after(kind: str, body: str) -> str:
    """body (vol, i, v, g) after what a version adds."""
    sd = f"(0.12 * {u('sd', 'vol')})"
    new = {
        "invert": f"CASE WHEN {u('inv', 'vol')} < 0.5 THEN 1 - g ELSE g END",
        "gamma": f"pow(g, exp(ln(0.25) + (ln(4.0) - ln(0.25)) * {u('gamma', 'vol')}))",
        "texture": f"least(greatest(g + (0.05 + 0.2 * {u('sd', 'vol')}) * noise, 0), 1)",
        "rician": f"sqrt((g + {sd} * {normal('n1', 'vol', 'i')}) ** 2 + ({sd} * {normal('n2', 'vol', 'i')}) ** 2)",
        "dropout": f"CASE WHEN {u('drop', 'vol')} < 0.7 THEN g * (1 - least(1, 0.75 / (1 + exp(30 * (z / greatest(zm, 1) - 0.30))) + 0.25 / (1 + exp(-25 * (abs(x / greatest(xm, 1) - 0.5) - 0.38)))) * 0.8 * {u('amount', 'vol')}) ELSE g END",
    }.get(kind)
    if not new:
        return body
    if kind == "texture":
        body = _texture(_places(body))
    elif kind == "dropout":
        body = f"SELECT *, max(z) OVER (PARTITION BY vol) AS zm, max(x) OVER (PARTITION BY vol) AS xm FROM ({_places(body)})"
    body = f"SELECT vol, i, v, CASE WHEN {FG} THEN {new} ELSE 0 END AS g FROM ({body})"
    return minmax(body) if kind == "rician" else body


def _version_sql(version: str) -> str:
    if version == "v26_15":
        first = _remap_sql(_AS_DESCRIBED["v26_6"])
        again = _remap_sql(_AS_DESCRIBED["v26_6"], 43, "y1").replace("WITH ", f"WITH y1 AS (SELECT a.vol, a.i, b.z, b.y, b.x, b.label, a.g AS v FROM ({first}) a JOIN {{vox}} b ON a.vol = b.vol AND a.i = b.i),\n", 1)
        cut = again.rindex("\nSELECT s.vol")
        return f"{again[:cut]}\nSELECT vol, i, round(g, 5) AS g FROM ({again[cut + 1 :]})"
    text = _remap_sql(_AS_DESCRIBED[version if version in _AS_DESCRIBED else "v26_6"])
    cut = text.index("\nSELECT s.vol")
    return f"{text[:cut]}\nSELECT vol, i, round(g, 5) AS g FROM ({_after(_AFTER.get(version, ''), text[cut + 1 :])})"


def _register(version: str) -> None:
    def f(vox):
        return R.generate(vox, version).select("vol", "i", F.round("g", 5).alias("g"))

    query(f"tg_{version}", "vox", _version_sql(version))(f)


for _v in R.VERSIONS:
    if _v != "raw":
        _register(_v)

_PLAIN = dict(_AS_DESCRIBED["raw"], one=0.0, uncut=0.0)


@query("join_voronoi", "vox", _parcels(_PLAIN) + " SELECT vol, i, cluster, cell::INT AS cell FROM cel")
def join_voronoi(vox):
    j = vox.join(R.kmeans_1d(vox, [2, 3, 4, 5, 6], 42), "vol").withColumn("cluster", R.cluster_of(F.col("v"), F.col("centroids")))
    return R.voronoi(j, list(range(2, 11)), 42, 0.0).select("vol", "i", "cluster", F.col("cell").cast("int").alias("cell"))


@query("voronoi_ids", "vox", _parcels(dict(_PLAIN, uncut=0.4)) + " SELECT vol, region, count(*) AS n FROM reg GROUP BY ALL")
def voronoi_ids(vox):
    j = vox.join(R.kmeans_1d(vox, [2, 3, 4, 5, 6], 42), "vol").withColumn("cluster", R.cluster_of(F.col("v"), F.col("centroids")))
    j = R.voronoi(j, list(range(2, 11)), 42, 0.4)
    return j.groupBy("vol", (F.col("cluster") * 100 + F.col("cell")).cast("int").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_seeds", "vox", f"SELECT vol, label, i FROM (SELECT *, row_number() OVER (PARTITION BY vol, label ORDER BY md5(concat_ws(':', '42', 'seed', vol::VARCHAR, i::VARCHAR)), vol, i) AS n FROM {{vox}} WHERE {FG}) WHERE n <= {pick(range(2, 11), 'S', 'vol', 'label')}")
def sample_seeds(vox):
    from scanframe.operators.sampling import hash_sample

    n = rng.choice(list(range(2, 11)), 42, "S", "vol", "label")
    return hash_sample(vox.where(R.foreground()), ["vol", "label"], n, 42, "seed", "vol", "i").select("vol", "label", "i")


def _clamped(o: dict, sigma: str, zed: str, finish: str = "") -> str:
    """Clamped remap, a blur drawn by sigma, z-scores; columns vol, i, g, zed."""
    text = _remap_sql(o)
    cut = text.index("\nSELECT s.vol")
    body = f"SELECT vol, i, v, CASE WHEN {FG} THEN least(greatest(g, 0), 1) ELSE 0 END AS g FROM ({text[cut + 1 :]})"
    blurred = lambda src, tag, seed: " UNION ALL ".join(f"SELECT * FROM ({_filtered(Wn.gaussian(max(1, int(3 * s + 0.5)), s), src, 'g') if s else src}) WHERE {sigma.replace('TAG', tag).replace('SEED', str(seed))} = {s}" for s in (0.0, 0.5, 1.0))
    return f"{text[:cut]},\nfirst AS ({_places(body)}),\nsmooth AS ({blurred('SELECT * FROM first', 'sigma', 42)}){finish and ','}{finish.replace('BLURRED', blurred('SELECT * FROM second', 'sigma', 43))}\n{zed}"


_ZED = "SELECT vol, i, round(g, 5) AS g, round(CASE WHEN v > 0.01 THEN (g - m) / sqrt(s + 1e-7) ELSE 0 END, 5) AS zed FROM {0} JOIN (SELECT vol AS w, avg(g) AS m, var_pop(g) AS s FROM {0} WHERE v > 0.01 GROUP BY vol) ON vol = w"
_EACH, _TOGETHER = pick([0.0, 0.5, 1.0], "TAG", "vol", seed="SEED"), pick([0.0, 0.5, 1.0], "TAG", seed="SEED")


@query("vol_fast", "vox", _clamped(_AS_DESCRIBED["raw"], _EACH, _ZED.format("smooth")))
def vol_fast(vox):
    return R.synthesise(vox).select("vol", "i", F.round("g", 5).alias("g"), F.round("zed", 5).alias("zed"))


@query("batch_fast", "vox", _clamped(_AS_DESCRIBED["raw"], _TOGETHER, _ZED.format("smooth")))
def batch_fast(vox):
    """One blur for all volumes."""
    return R.synthesise(vox, together=True).select("vol", "i", F.round("g", 5).alias("g"), F.round("zed", 5).alias("zed"))


_SECOND = f"""
means AS (SELECT vol AS lv, label AS ll, avg(g) AS lm, count(*) AS ln FROM smooth WHERE label > 0 GROUP BY ALL),
second AS (SELECT * REPLACE (CASE WHEN label > 0 AND ln >= 4 AND {u('use', 'vol', 'label', seed=43)} < 0.5 THEN least(greatest({u('lmu', 'vol', 'label', seed=43)} + {_signed('lalpha', 'vol', 'label', seed=43)} * (g - lm), 0), 1) ELSE g END AS g) FROM smooth LEFT JOIN means ON lv = vol AND ll = label),
third AS (BLURRED)"""


@query("vol_fast_v2", "vox", _clamped(_AS_DESCRIBED["raw"], _TOGETHER, _ZED.format("third"), _SECOND))
def vol_fast_v2(vox):
    return R.synthesise_labels(vox).select("vol", "i", F.round("g", 5).alias("g"), F.round("zed", 5).alias("zed"))


def _blurred(source: str, sigma: str) -> str:
    """g of source blurred by the width that sigma gives for the volume."""
    return " UNION ALL ".join(f"SELECT * FROM ({_filtered(Wn.gaussian(max(1, int(3 * s + 0.5)), s), source, 'g') if s else source}) WHERE {sigma.replace('TAG', 'sigma').replace('SEED', '42')} = {s}" for s in (0.0, 0.5, 1.0))


def _labelled(text: str, prepare: str, finish: str, deviation: str, source: str = "{vox}") -> str:
    """Generator text, then blur and z-scores inside the labels; deviation of g over them."""
    cut = text.index("\nSELECT s.vol")
    return f"""{text[:cut]},
first AS (SELECT b.vol, b.i, b.z, b.y, b.x, b.label, b.v, {prepare} AS g FROM ({text[cut + 1 :]}) a JOIN {source} b ON a.vol = b.vol AND a.i = b.i),
done AS (SELECT vol, i, label, {finish} AS g FROM ({_blurred('SELECT * FROM first', _EACH)}))
SELECT vol, i, round(g, 5) AS g, round(CASE WHEN label > 0 THEN (g - m) / s ELSE 0 END, 5) AS zed FROM done JOIN (SELECT vol AS w, avg(g) AS m, {deviation} AS s FROM done WHERE label > 0 GROUP BY vol) ON vol = w"""


_PATCH = "(SELECT * REPLACE (CASE WHEN label > 0 THEN greatest(v, 0.01 * (1 + 1e-9)) ELSE 0 END AS v) FROM {all} WHERE z < 6)"


@query("patch_fast", "vox", _labelled(_remap_sql(_AS_DESCRIBED["raw"], 42, _PATCH, "{all}"), "CASE WHEN label > 0 THEN least(greatest(g, 0), 1) ELSE 0 END", "CASE WHEN v < 0.01 THEN 0 ELSE g END", "sqrt(var_pop(g) + 1e-7)"))
def patch_fast(vox):
    """The lower part of each volume, with the clusters of the whole."""
    centres = R.kmeans_1d(vox, [2, 3, 4, 5, 6], 42)
    return R.synthesise_patches(vox.where("z < 6"), centres).select("vol", "i", F.round("g", 5).alias("g"), F.round("zed", 5).alias("zed"))


@query("vol_label_mask", "vox", _labelled(_remap_sql(_AS_DESCRIBED["v26_6"]), "g", "CASE WHEN v < 0.01 THEN 0 ELSE least(greatest(g, 0), 1) END", "stddev_samp(g) + 1e-7"))
def vol_label_mask(vox):
    return R.synthesise_in_labels(vox).select("vol", "i", F.round("g", 5).alias("g"), F.round("zed", 5).alias("zed"))


@query("vol_debug_v2", "vox", _parcels(_PLAIN) + " SELECT vol, cluster, count(*) AS voxels, count(DISTINCT cell) AS cells FROM cel GROUP BY ALL")
def vol_debug_v2(vox):
    j = vox.join(R.kmeans_1d(vox, [2, 3, 4, 5, 6], 42), "vol").withColumn("cluster", R.cluster_of(F.col("v"), F.col("centroids")))
    return R.voronoi(j, list(range(2, 11)), 42, 0.0).groupBy("vol", "cluster").agg(F.count(F.lit(1)).alias("voxels"), F.count_distinct("cell").alias("cells"))


_SMOOTH64 = " + ".join(f"coalesce({'lag' if o <= 0 else 'lead'}(w, {abs(o)}) OVER o, 0) * {Wn.gaussian(3, 1.0)[o + 3]!r}" for o in range(-3, 4))
_HIST64 = """SELECT vol, bin, sum(w) AS w FROM (SELECT vol, unnest([struct_pack(bin := least(greatest(floor(p), 0), 63)::INT, w := least(greatest(floor(p) + 1 - p, 0), 1)),
  struct_pack(bin := least(greatest(floor(p) + 1, 0), 63)::INT, w := least(greatest(p - floor(p), 0), 1))], recursive := true) FROM (SELECT vol, v / (1.0 / 63 + 1e-8) AS p FROM {vox})) GROUP BY ALL"""
_PEAKS = f"""SELECT vol AS qv, list(bin / 63.0 ORDER BY n) AS q FROM (SELECT vol, bin, row_number() OVER (PARTITION BY vol ORDER BY s DESC, bin) AS n FROM (SELECT vol, bin, s, coalesce(lag(s) OVER o, s) AS l, coalesce(lead(s) OVER o, s) AS r
 FROM (SELECT vol, bin, round({_SMOOTH64}, 9) AS s FROM (SELECT g.vol, g.bin, coalesce(h.w, 0) AS w FROM (SELECT vol, b::INT AS bin FROM (SELECT DISTINCT vol FROM {{vox}}), range(0, 64) t(b)) g LEFT JOIN ({_HIST64}) h ON g.vol = h.vol AND g.bin = h.bin) WINDOW o AS (PARTITION BY vol ORDER BY bin))
 WINDOW o AS (PARTITION BY vol ORDER BY bin)) WHERE s >= l AND s >= r) WHERE n <= 4 GROUP BY vol"""


def _soft(centres: str, temperature: float, extra: str, dark: str) -> str:
    """Softmax over the list q of centres, times drawn targets."""
    w = f"list_transform(range(0, len(q)), lambda k: exp(-pow(v - q[k + 1], 2) / {temperature} - top))"
    hit = f"list_sum(list_transform(range(0, len(q)), lambda k: exp(-pow(v - q[k + 1], 2) / {temperature} - top) * {u('target', 'vol', 'k')}))"
    near = f"SELECT *, list_max(list_transform(range(0, len(q)), lambda k: -pow(v - q[k + 1], 2) / {temperature})) AS top FROM {{vox}} JOIN ({centres}) ON vol = qv"
    return f"SELECT vol, i, round(CASE WHEN {dark} THEN least(greatest({hit} / list_sum({w}){extra}, 0), 1) ELSE 0 END, 6) AS g FROM ({near})"


@query("tg_v17_anchor", "vox", _soft(_PEAKS, 0.01, "", FG))
def tg_v17_anchor(vox):
    return show(R.generate(vox, "v17"))


_C8 = "greatest(0, least(ceil(v * 8) - 1, 7))::INT"


@query("tg_v19_label", "vox", f"""WITH m AS (SELECT vol AS mv, label AS ml, avg(v) AS m FROM {{vox}} WHERE label IN (1, 2, 3) GROUP BY ALL),
g AS (SELECT vol, i, v, CASE WHEN NOT ({FG}) THEN 0 WHEN m IS NOT NULL AND {u('use', 'vol', 'label')} > 0.5 THEN {u('lmu', 'vol', 'label')} + (0.5 + 1.5 * {u('lalpha', 'vol', 'label')}) * (v - m)
 ELSE {u('mu', 'vol', 'k')} + (0.5 + 1.5 * {u('alpha', 'vol', 'k')}) * (v - (k + 0.5) / 8) END AS g FROM (SELECT *, {_C8} AS k FROM {{vox}}) LEFT JOIN m ON mv = vol AND ml = label)
{out(minmax('SELECT * FROM g'))}""")
def tg_v19_label(vox):
    return show(R.generate(vox, "v19"))


def _blobs_sql() -> str:
    one = lambda seed: levels(_K7, "uniform", seed=seed)
    ctes, g, joins = [f"r0 AS ({one(42)})"], "r0.g", ""
    for b in range(3):
        ctes += [f"r{b + 1} AS ({one(43 + b)})", f"m{b} AS (SELECT vol, z, y, x FROM {{vox}} WHERE {FG} QUALIFY row_number() OVER (PARTITION BY vol ORDER BY md5(concat_ws(':', '42', 'middle{b}', vol::VARCHAR, i::VARCHAR)), vol, i) = 1)"]
        far = " + ".join(f"pow((a.{t} - m{b}.{t}) / (15.0 + 65.0 * {u(f'r{b}{t}', 'a.vol')}), 2)" for t in ("z", "y", "x"))
        g = f"CASE WHEN {far} <= 1 AND {u('blobs', 'a.vol')} * 4 > {b + 1} THEN r{b + 1}.g ELSE {g} END"
        joins += f" JOIN m{b} ON m{b}.vol = a.vol JOIN r{b + 1} ON r{b + 1}.vol = a.vol AND r{b + 1}.i = a.i"
    return f"WITH {', '.join(ctes)} SELECT a.vol, a.i, round(CASE WHEN a.v > 0.01 THEN least(greatest({g}, 0), 1) ELSE 0 END, 6) AS g FROM {{vox}} a JOIN r0 ON r0.vol = a.vol AND r0.i = a.i{joins}"


@query("tg_v25_blobs", "vox", _blobs_sql())
def tg_v25_blobs(vox):
    return show(R.generate(vox, "v25"))


@query("tg_synthseg", "vox", f"SELECT vol, i, round(CASE WHEN NOT ({FG}) THEN 0 WHEN label IN (1, 2, 3) THEN least(greatest({u('gm', 'vol', 'label')} + (0.02 + 0.13 * {u('gs', 'vol', 'label')}) * {normal('gn', 'vol', 'i')}, 0), 1) ELSE v END, 6) AS g FROM {{vox}}")
def tg_synthseg(vox):
    return show(R.generate(vox, "synthseg"))


@query("tg_v27a", "vox", f"""WITH q AS (SELECT vol, label, count(*) AS n, CASE {pick([2, 3, 4, 6, 8], 'K', 'vol', 'label')} {' '.join(f"WHEN {n} THEN quantile_cont(v, [{', '.join(f'{j} / {n}.0' for j in range(n + 1))}])" for n in (2, 3, 4, 6, 8))} END AS e FROM {{vox}} WHERE {FG} AND label > 0 GROUP BY vol, label),
j AS (SELECT a.vol, a.i, a.v, coalesce({FG} AND a.label > 0 AND n >= 100, false) AS use, CASE WHEN coalesce({FG} AND a.label > 0 AND n >= 100, false) THEN a.label * 100 + greatest(0, least(len(list_filter(e, lambda b: b < v)) - 1, len(e) - 2)) ELSE -1 END::INT AS region FROM {{vox}} a LEFT JOIN q ON q.vol = a.vol AND q.label = a.label),
g AS (SELECT p.vol, p.i, p.v, CASE WHEN use THEN g WHEN p.v > 0.01 THEN p.v ELSE 0 END AS g FROM ({affine('SELECT vol, i, v, region FROM j', _MU, _AL)}) p JOIN j ON j.vol = p.vol AND j.i = p.i)
{out(minmax('SELECT * FROM g'))}""")
def tg_v27a(vox):
    return show(R.generate(vox, "v27a"))


def _bis_sql() -> str:
    text = _remap_sql(_AS_DESCRIBED["v26_4"])
    cut = text.index("\nSELECT s.vol")
    return f"""{text[:cut]},
f AS ({_places(text[cut + 1 :])}), lm AS (SELECT vol AS lv, label AS ll, avg(g) AS m, count(*) AS n FROM f WHERE {FG} AND label > 0 GROUP BY ALL),
h AS (SELECT vol, i, v, CASE WHEN {FG} AND label > 0 AND n >= 100 AND {u('use', 'vol', 'label')} < 0.5 THEN {u('lmu', 'vol', 'label')} + (0.5 + 1.5 * {u('lalpha', 'vol', 'label')}) * (g - m) ELSE g END AS g FROM f LEFT JOIN lm ON lv = vol AND ll = label)
SELECT vol, i, round(g, 5) AS g FROM ({minmax('SELECT * FROM h')})"""


@query("tg_v27a_bis", "vox", _bis_sql())
def tg_v27a_bis(vox):
    return R.generate(vox, "v27a_bis").select("vol", "i", F.round("g", 5).alias("g"))


@query("fn_unsharp", "vox", f"SELECT vol, i, round(least(greatest(o + 0.7 * (o - v), 0), 1), 6) AS g FROM ({_filtered(Wn.gaussian(3, 1.0), 'SELECT *, v AS o FROM {vox}')})")
def fn_unsharp(vox):
    return show(R.unsharp(vox, 0.7, 1.0))


_KEPT = "SELECT *, v AS o FROM {vox}"
_LOW = f"((0.5 + 0.5 * {u('la', 'vol')}) * v + 0.3 * {u('lb', 'vol')})"


@query("fn_lpci", "vox", f"SELECT vol, i, round(least(greatest({_LOW} + (0.8 + 0.4 * {u('d0', 'vol')}) * (b - v) + (0.8 + 0.4 * {u('d1', 'vol')}) * (o - b), 0), 1), 6) AS g FROM ({_filtered(Wn.gaussian(6, 2.0), f'SELECT *, v AS b FROM ({_filtered(Wn.gaussian(3, 1.0), _KEPT)})')})")
def fn_lpci(vox):
    return show(R.pyramid(vox, 42))


@query("fn_fractal_noise", "vox", f"SELECT vol, i, round(noise, 6) AS noise FROM ({_texture('SELECT * FROM {vox}')})")
def fn_fractal_noise(vox):
    return R.fractal_noise(vox, 42).select("vol", "i", F.round("noise", 6).alias("noise"))


@query("fn_noise", "vox", f"SELECT vol, i, round(least(greatest(v + {u('sd', 'vol')} * 0.1 * {normal('an', 'vol', 'i')}, 0), 1), 6) AS g FROM {{vox}}")
def fn_noise(vox):
    return show(R.add_noise(vox, 42, 0.1))


@query("fn_anisotropic", "vox", """WITH b AS (SELECT vol, y, x, z // 4 AS b, avg(v) AS a FROM {vox} GROUP BY ALL), l AS (SELECT vol, y, x, max(b) AS last FROM b GROUP BY ALL),
p AS (SELECT a.vol, a.i, a.y, a.x, greatest(0, least((z + 0.5) / 4 - 0.5, last)) AS p, last FROM {vox} a JOIN l USING (vol, y, x))
SELECT p.vol, p.i, round(lo.a * (1 - (p - floor(p))) + hi.a * (p - floor(p)), 6) AS out FROM p JOIN b lo ON lo.vol = p.vol AND lo.y = p.y AND lo.x = p.x AND lo.b = floor(p) JOIN b hi ON hi.vol = p.vol AND hi.y = p.y AND hi.x = p.x AND hi.b = least(floor(p) + 1, last)""")
def fn_anisotropic(vox):
    return R.anisotropic(vox, 4).select("vol", "i", r6("out").alias("out"))


@query("fn_lowres", "vox", "SELECT a.vol, a.i, round(m, 6) AS out FROM {vox} a JOIN (SELECT vol, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS m FROM {vox} GROUP BY ALL) b ON a.vol = b.vol AND a.z // 2 = b.z AND a.y // 2 = b.y AND a.x // 2 = b.x")
def fn_lowres(vox):
    half = {f"h{a}": F.floor(F.col(a) / 2) for a in Wn.AXES}
    d = vox.withColumns(half)
    return d.join(d.groupBy("vol", *half).agg(F.avg("v").alias("m")), ["vol", *half]).select("vol", "i", r6("m").alias("out"))


@query("fn_smooth", "vox", f"SELECT vol, i, round(v, 6) AS g FROM ({_filtered(Wn.gaussian(2, 0.8))})")
def fn_smooth(vox):
    return show(Wn.blur(vox, 0.8).withColumn("g", F.col("v")))


@query("fn_soft_quantile", "vox", _soft("SELECT vol AS qv, quantile_cont(v, [0.1, 0.3, 0.5, 0.7, 0.9]) AS q FROM {vox} GROUP BY vol", 0.05, f" + 0.02 * {normal('rn', 'vol', 'i')}", "v > 1e-4"))
def fn_soft_quantile(vox):
    return show(R.soft_quantiles(vox, 42))


_GQ = "[" + ", ".join(f"{i} / 99.0" for i in range(100)) + "]"
_GC = f"list_transform(range(0, 100), lambda b: b / 99.0)"
_AT = "(CASE WHEN len(list_filter({xs}, lambda e: e <= {x})) = 0 THEN {ys}[1] WHEN len(list_filter({xs}, lambda e: e <= {x})) = len({xs}) THEN {ys}[len({ys})] ELSE {ys}[len(list_filter({xs}, lambda e: e <= {x}))] + ({x} - {xs}[len(list_filter({xs}, lambda e: e <= {x}))]) / ({xs}[len(list_filter({xs}, lambda e: e <= {x})) + 1] - {xs}[len(list_filter({xs}, lambda e: e <= {x}))]) * ({ys}[len(list_filter({xs}, lambda e: e <= {x})) + 1] - {ys}[len(list_filter({xs}, lambda e: e <= {x}))]) END)"


@query("fn_gmm_match", "vox", f"""WITH p AS (SELECT vol, k, {u('gm', 'vol', 'k')} AS m, 0.02 + 0.08 * {u('gs', 'vol', 'k')} AS s, 0.1 + 0.9 * {u('gw', 'vol', 'k')} AS w FROM (SELECT vol, unnest(range(0, n)) AS k FROM (SELECT DISTINCT vol, {pick([3, 4, 5, 6], 'peaks', 'vol')} AS n FROM {{vox}}))),
d AS (SELECT vol, b, sum(w / s * exp(-0.5 * pow((b / 99.0 - m) / s, 2))) AS d FROM p, range(0, 100) t(b) GROUP BY ALL),
c AS (SELECT vol, list(c ORDER BY b) AS cdf FROM (SELECT vol, b, sum(d) OVER (PARTITION BY vol ORDER BY b) / sum(d) OVER (PARTITION BY vol) AS c FROM d) GROUP BY vol),
t AS (SELECT vol AS tv, list(y ORDER BY b) AS ys FROM (SELECT vol, b, {_AT.format(x='q', xs='cdf', ys='centre')} AS y FROM (SELECT vol, cdf, b, b / 99.0 AS q, {_GC} AS centre FROM c, range(0, 100) r(b))) GROUP BY vol),
x AS (SELECT vol AS xv, CASE WHEN count(*) FILTER (WHERE v > 1e-4) >= 2 THEN quantile_cont(v, {_GQ}) FILTER (WHERE v > 1e-4) ELSE quantile_cont(v, {_GQ}) END AS xs FROM {{vox}} GROUP BY vol)
SELECT vol, i, round(CASE WHEN v > 1e-4 THEN least(greatest({_AT.format(x='v', xs='xs', ys='ys')}, 0), 1) ELSE 0 END, 6) AS g FROM {{vox}} JOIN t ON tv = vol JOIN x ON xv = vol""")
def fn_gmm_match(vox):
    return show(R.gmm_match(vox, 42))


def _held(kernels: dict[str, list[float]]) -> str:
    """Filters along the axes, end values held."""
    source = "SELECT * FROM {vox}"
    for a, k in kernels.items():
        others, r = ", ".join(x for x in ("z", "y", "x") if x != a), len(k) // 2
        terms = " + ".join(f"coalesce({'lag' if o <= 0 else 'lead'}(v, {abs(o)}) OVER w, {'first' if o <= 0 else 'last'}_value(v) OVER f) * {k[o + r]!r}" for o in range(-r, r + 1))
        source = f"SELECT * REPLACE ({terms} AS v) FROM ({source}) WINDOW w AS (PARTITION BY vol, {others} ORDER BY {a}), f AS (PARTITION BY vol, {others} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"SELECT vol, i, round(v, 6) AS g FROM ({source})"


@query("blur_mm", "vox", _held({a: Wn.gaussian(max(1, int(3 * 1.2 / s + 0.5)), 1.2 / s) for a, s in (("z", 2.0), ("y", 1.0), ("x", 0.8))}))
def blur_mm(vox):
    return show(R.blur_mm(vox, 1.2, {"z": 2.0, "y": 1.0, "x": 0.8}).withColumn("g", F.col("v")))


@query("fn_bigaug_gamma", "vox", f"SELECT vol, i, round(CASE WHEN {u('gg', 'vol')} < 0.5 THEN pow(v, exp(ln(0.7) + (ln(1.5) - ln(0.7)) * {u('gamma', 'vol')})) ELSE v END, 6) AS g FROM {{vox}}")
def fn_bigaug_gamma(vox):
    return show(R.gamma(vox, 42))


@query("fn_perturb_identity", "vox", "SELECT vol, i, round(v, 6) AS g FROM {vox}")
def fn_perturb_identity(vox):
    return show(R.PERTURBERS["identity"](vox, 42))


@query("fn_perturb_bezier", "vox", f"SELECT vol, i, round(CASE WHEN {FG} THEN 3 * (1 - v) * (1 - v) * v * {u('b1', 'vol')} + 3 * (1 - v) * v * v * {u('b2', 'vol')} + v * v * v ELSE 0 END, 6) AS g FROM {{vox}}")
def fn_perturb_bezier(vox):
    return show(R.PERTURBERS["bezier"](vox, 42))


@query("fn_perturb_noise", "vox", f"SELECT vol, i, round(CASE WHEN {FG} THEN least(greatest(v + 0.2 * noise, 0), 1) ELSE 0 END, 6) AS g FROM ({_texture('SELECT * FROM {vox}')})")
def fn_perturb_noise(vox):
    return show(R.PERTURBERS["procedural_noise"](vox, 42))


@query("fn_perturb_mild", "vox", _held(dict.fromkeys(("z", "y", "x"), Wn.gaussian(4, 1.0))))
def fn_perturb_mild(vox):
    return show(R.PERTURBERS["mild_gaussian"](vox, 42))


@query("fn_perturb_heavy", "vox", _held(dict.fromkeys(("z", "y", "x"), Wn.gaussian(10, 3.0))))
def fn_perturb_heavy(vox):
    return show(R.PERTURBERS["heavy_gaussian"](vox, 42))
