"""Queries with dense linear algebra, graphs and images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanframe.operators import linear as L
from scanframe.operators import manifold as M
from scanframe.operators.neighbors import knn
from scanframe.operators.sampling import hash_sample
from scanframe.plans.catalog import query

r6 = lambda c: F.round(c, 6)


def _vec(feats):
    return feats.withColumn("vec", F.transform("embedding", lambda x: x.cast("double")))


def _projected(feats, where=None, share=0.95):
    d = _vec(feats)
    p = L.pca(d, where=where)
    k = p.count(share)
    return p.project(d, k).select("vec_id", F.size("pc").alias("k"), r6(F.sqrt(F.aggregate("pc", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))


@query("fs_pca_joint", "feats")
def fs_pca_joint(feats):
    return _projected(feats)


@query("fs_pca_orig", "feats")
def fs_pca_orig(feats):
    return _projected(feats, "cohort = 'real'")


@query("fs_pca_frac", "feats")
def fs_pca_frac(feats):
    return _projected(feats, "cohort = 'real'", 0.6)


@query("fs_pca_pair", "feats")
def fs_pca_pair(feats):
    return _projected(feats.where("modality IN ('m0', 'm1')"), "cohort = 'real'")


def _rows(d, rows, schema):
    return d.sparkSession.createDataFrame(rows, schema)


@query("win_cumvar", "feats")
def win_cumvar(feats):
    p = L.pca(_vec(feats))
    return _rows(feats, [(k, round(float(c), 6)) for k, c in enumerate(np.cumsum(p.ratio))], "component int, cumulative double")


@query("fs_loadings", "feats")
def fs_loadings(feats):
    p = L.pca(_vec(feats))
    rows = [(j, int(i), round(float(p.axes[i, j]), 6)) for j in range(3) for i in np.argsort(-np.abs(p.axes[:, j]), kind="stable")[:10]]
    return _rows(feats, rows, "component int, dim int, loading double")


@query("fs_lda", "feats")
def fs_lda(feats):
    d = _vec(feats)
    _, axes = L.lda(d, "modality")
    cols = [F.aggregate(F.zip_with("vec", F.array(*map(F.lit, map(float, a))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a in axes.T]
    return d.select("vec_id", "modality", *[F.round(c, 4).alias(f"ld{k + 1}") for k, c in enumerate(cols)])


@query("vendi", "feats")
def vendi(feats):
    synth = hash_sample(_vec(feats).where("cohort = 'synth'"), ["modality"], 150, 42, "vendi", "vec_id")
    return L.vendi_scores(synth, ["modality"]).withColumn("vendi", r6("vendi"))


@query("cov_hull", "feats")
def cov_hull(feats):
    d = L.pca(_vec(feats)).project(_vec(feats), 2)
    types = "modality string, share double"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, real = np.stack(f["pc"].to_numpy()), (f["cohort"] == "real").to_numpy()
        return pd.DataFrame({"modality": [f["modality"].iloc[0]], "share": [round(L.hull_coverage(x[real], x[~real], 0.3), 6)]})

    return d.select("modality", "cohort", "pc").groupBy("modality").applyInPandas(run, types)


def _graph(feats):
    """Nearest-neighbour edges with weights that fall with the distance."""
    d = _vec(feats)
    e = knn(d, d, "vec_id", "vec", 8, exclude_self=True).select(F.col("q").alias("src"), F.col("b").alias("dst"), F.exp(-F.col("dist") / 4).alias("w"))
    return d, M.symmetric(e).where("src < dst")


def _tagged(feats):
    d, e = _graph(feats)
    nodes = d.select(F.lit(0).alias("kind"), F.col("vec_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w"), "cohort", F.concat_ws("/", "modality", "scanner").alias("grp"))
    return nodes.unionByName(e.select(F.lit(1).alias("kind"), "src", "dst", "w", F.lit(None).cast("string").alias("cohort"), F.lit(None).cast("string").alias("grp")))


def _over_graph(feats, fn, schema):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        n, e = f[f["kind"] == 0], f[f["kind"] == 1][["src", "dst", "w"]].sort_values(["src", "dst"]).astype({"src": "int64", "dst": "int64"})
        return fn(e, pd.DataFrame({"id": n["src"].astype("int64"), "real": n["cohort"] == "real", "grp": n["grp"]}).sort_values("id"))

    return _tagged(feats).withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, schema)  # one task: all nodes, up to 8 edges each


@query("graph_filtration", "feats")
def graph_filtration(feats):
    return _over_graph(feats, lambda e, n: L.filtration(e, n).round(6), "tau double, n_comp_real bigint, n_comp_real_in_combined bigint, bridge_gap bigint")


@query("graph_fiedler", "feats")
def graph_fiedler(feats):
    def fn(e, n):
        real = set(n.loc[n["real"], "id"])
        own = e[e["src"].isin(real) & e["dst"].isin(real)]
        return pd.DataFrame({"nodes": ["real", "all"], "fiedler": [round(L.fiedler(own, sorted(real)), 6), round(L.fiedler(e, list(n["id"])), 6)]})

    return _over_graph(feats, fn, "nodes string, fiedler double")


@query("graph_bottleneck", "feats")
def graph_bottleneck(feats):
    fn = lambda e, n: L.bottlenecks(e, n[n["real"]].groupby("grp")["id"].min().to_dict()).round(6)
    return _over_graph(feats, fn, "group_a string, group_b string, bottleneck_weight double, path_hops bigint")


@query("graph_islands", "feats")
def graph_islands(feats):
    def fn(e, n):
        curve = L.filtration(e, n)
        few = curve[curve["n_comp_real"] <= 10]
        tau = few["tau"].max() if len(few) else curve["tau"].min()
        real = n[n["real"]]
        u = L.Union(real["id"])
        for a, b, w in e.itertuples(index=False):
            if w >= tau and a in u.up and b in u.up:
                u.join(a, b)
        g = real.assign(island=[u.find(i) for i in real["id"]]).groupby("island")["grp"]
        return pd.DataFrame({"island": list(g.groups), "dominant": [x.mode().min() for _, x in g], "size": g.size().to_list()})

    return _over_graph(feats, fn, "island bigint, dominant string, size bigint")


@query("sample_sobol", "region")
def sample_sobol(region):
    p = L.sobol(16, 6, 42)
    return _rows(region, [(i, j, float(p[i, j])) for i in range(64) for j in range(16)], "i int, dim int, u double")


def _volume(fn):
    """Rows (vol, i, out) from a function of one dense volume and its number."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = fn(L.dense(f), int(f["vol"].iloc[0]))
        return pd.DataFrame({"vol": f["vol"], "i": f["i"], "out": np.round(out[f["z"], f["y"], f["x"]].astype(float), 6)})

    return run


@query("mask_morphology", "vox")
def mask_morphology(vox):
    return L.per_volume(vox, _volume(lambda a, _: L.brain_mask(a, 0.5, 1, 1)), "vol int, i int, out double")


@query("fn_fourier_amp", "vox")
def fn_fourier_amp(vox):
    return L.per_volume(vox, _volume(lambda a, v: L.fourier_amplitude(a, 0.3, 0.25, v)), "vol int, i int, out double")


@query("fn_elastic", "vox")
def fn_elastic(vox):
    return L.per_volume(vox, _volume(lambda a, v: L.sample_at(a, L.elastic_places(a.shape, v))), "vol int, i int, out double")


@query("fn_affine_aug", "vox")
def fn_affine_aug(vox):
    return L.per_volume(vox, _volume(lambda a, v: L.sample_at(a, L.affine_places(a.shape, v))), "vol int, i int, out double")


@query("fn_resolution", "vox")
def fn_resolution(vox):
    def zoom(a, v):
        f = np.random.default_rng(v).uniform(0.3, 1.0)
        n = [max(1, round(s * f)) for s in a.shape]
        grid = np.stack(np.meshgrid(*[np.linspace(0, s - 1, k) for s, k in zip(a.shape, n, strict=True)], indexing="ij"))
        small = L.sample_at(a, grid)
        back = np.stack(np.meshgrid(*[np.linspace(0, k - 1, s) for s, k in zip(a.shape, n, strict=True)], indexing="ij"))
        return L.sample_at(small, back)

    return L.per_volume(vox, _volume(zoom), "vol int, i int, out double")


@query("feat_hog2d", "vox")
def feat_hog2d(vox):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        a = L.dense(f)
        v = np.concatenate([L.hog2d(a.take(a.shape[k] // 2, axis=k), 3) for k in range(3)])
        return pd.DataFrame({"vol": [f["vol"].iloc[0]] * len(v), "feature": np.arange(len(v)), "value": np.round(v, 6)})

    return L.per_volume(vox, run, "vol int, feature int, value double")


@query("label_em", "vox")
def label_em(vox):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f["v"].to_numpy()
        fg = x > 0.01
        v, k = x[fg], 4
        m, s, w = np.quantile(v, (np.arange(k) + 0.5) / k), np.full(k, v.std() / k + 1e-6), np.full(k, 1 / k)
        for _ in range(50):
            p = w * np.exp(-0.5 * ((v[:, None] - m) / s) ** 2) / s + 1e-300
            p /= p.sum(1, keepdims=True)
            n = p.sum(0)
            m, w = (p * v[:, None]).sum(0) / n, n / n.sum()
            s = np.sqrt((p * (v[:, None] - m) ** 2).sum(0) / n) + 1e-6
        lab = np.zeros(len(x), int)
        lab[fg] = np.argsort(np.argsort(m))[p.argmax(1)] + 1
        return pd.DataFrame({"vol": f["vol"], "i": f["i"], "label": lab})

    return L.per_volume(vox, run, "vol int, i int, label int")
