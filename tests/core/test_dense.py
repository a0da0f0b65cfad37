"""Queries that SQL cannot express, on whole small tables against independent NumPy code."""

from collections import deque

import duckdb
import numpy as np
import pandas as pd
import pytest

from scanframe.functions.rng import host
from scanframe.operators import augment as A
from scanframe.operators import linear as L
from scanframe.plans import catalog, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: catalog.queries()[name](spark, SF).toPandas()


def view(name, sf=SF):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(views.oracle(f"SELECT * FROM {{{name}}}")).df()


@pytest.fixture(scope="module")
def feats():
    f = view("feats").sort_values("vec_id").reset_index(drop=True)
    return f.assign(grp=f["modality"] + "/" + f["scanner"]), np.stack(f["embedding"].to_numpy()).astype(float)


def dense_volumes(sf=SF):
    v = view("vox", sf)
    out = {}
    for vol, f in v.groupby("vol"):
        a, lab = np.zeros((2, f["z"].max() + 1, f["y"].max() + 1, f["x"].max() + 1))
        a[f["z"], f["y"], f["x"]], lab[f["z"], f["y"], f["x"]] = f["v"], f["label"]
        out[vol] = a, lab, f
    return out


@pytest.fixture(scope="module")
def volumes():
    return dense_volumes()


def axes(x):
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return s**2 / len(x), v


@pytest.mark.parametrize("name, fit, rows, share", [("fs_pca_joint", None, None, 0.95), ("fs_pca_orig", "real", None, 0.95), ("fs_pca_frac", "real", None, 0.6), ("fs_pca_pair", "real", ("m0", "m1"), 0.95)])
def test_pca(run, feats, name, fit, rows, share):
    f, x = feats
    keep = f["modality"].isin(rows) if rows else np.ones(len(f), bool)
    use = keep & (f["cohort"] == fit if fit else True)
    var, v = axes(x[use])
    k = max(3, int(np.searchsorted(np.cumsum(var) / var.sum(), share - 1e-12)) + 1)
    got = run(name).sort_values("vec_id")
    assert list(got["vec_id"]) == list(f["vec_id"][keep]) and set(got["k"]) == {k}
    assert got["norm"].to_numpy() == pytest.approx(np.linalg.norm((x[keep] - x[use].mean(0)) @ v[:k].T, axis=1), abs=1e-5)


def test_variance_and_loadings(run, feats):
    _, x = feats
    var, v = axes(x)
    assert run("win_cumvar").sort_values("component")["cumulative"].to_numpy() == pytest.approx(np.cumsum(var) / var.sum(), abs=1e-5)
    got = run("fs_loadings")
    for j in range(3):
        mine = v[j] * np.sign(v[j][np.abs(v[j]).argmax()])
        g = got[got["component"] == j]
        assert set(g["dim"]) == set(np.argsort(-np.abs(mine))[:10]) and g["loading"].to_numpy() == pytest.approx(mine[g["dim"]], abs=1e-5)


def test_lda(run, feats):
    f, x = feats
    means = {m: x[f["modality"] == m].mean(0) for m in set(f["modality"])}
    within = sum((x[f["modality"] == m] - c).T @ (x[f["modality"] == m] - c) for m, c in means.items()) / len(x) + 1e-6 * np.eye(x.shape[1])
    between = sum((f["modality"] == m).sum() / len(x) * np.outer(c - x.mean(0), c - x.mean(0)) for m, c in means.items())
    w, v = np.linalg.eig(np.linalg.solve(within, between))
    order = np.argsort(-w.real)[:2]
    got = run("fs_lda").sort_values("vec_id")
    for k, j in enumerate(order):
        a = v[:, j].real
        a /= np.sqrt(a @ within @ a)
        assert np.abs(got[f"ld{k + 1}"].to_numpy()) == pytest.approx(np.abs(x @ a), abs=2e-3)


def test_vendi(run, feats):
    f, x = feats
    got = run("vendi").set_index("modality")
    for m in got.index:
        s = x[(f["modality"] == m) & (f["cohort"] == "synth")]
        p = np.linalg.svd(s / np.linalg.norm(s, axis=1, keepdims=True), compute_uv=False) ** 2 / len(s)
        p = p[p > 1e-12]
        assert got.loc[m, "n"] == len(s) <= 150 and got.loc[m, "vendi"] == pytest.approx(np.exp(-(p * np.log(p)).sum()), abs=1e-4)


def test_hull(run, feats):
    f, x = feats
    _, v = axes(x)
    p = (x - x.mean(0)) @ (v[:2] * np.sign(v[:2][range(2), np.abs(v[:2]).argmax(1)])[:, None]).T
    got = run("cov_hull").set_index("modality")["share"]
    for m in got.index:
        real, synth = (p[(f["modality"] == m) & (f["cohort"] == c)] for c in ("real", "synth"))
        grid = np.stack(np.meshgrid(*[np.linspace(real[:, k].min(), real[:, k].max(), 60) for k in range(2)]), -1).reshape(-1, 2)
        gap = np.sort(np.arctan2(real[None, :, 1] - grid[:, None, 1], real[None, :, 0] - grid[:, None, 0]), axis=1)
        widest = np.maximum(np.diff(gap, axis=1).max(1), gap[:, 0] + 2 * np.pi - gap[:, -1])
        inside = grid[widest <= np.pi + 1e-9]  # no half plane through the point is free of real points
        near = np.array([(np.linalg.norm(synth - q, axis=1) <= 0.3).any() for q in inside])
        assert got[m] == pytest.approx(near.mean(), abs=3 / len(inside))


@pytest.fixture(scope="module")
def graph(feats):
    f, x = feats
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    g = np.zeros(d.shape)
    for i in range(len(d)):
        for j in sorted(range(len(d)), key=lambda j: (d[i, j], j))[:8]:
            g[i, j] = np.exp(-d[i, j] / 4)
    return (g + g.T) / 2, (f["cohort"] == "real").to_numpy(), f["grp"].to_numpy(), f["vec_id"].to_numpy()


def parts(g, nodes):
    """Component of each node by breadth-first search over the nodes given."""
    lab, inside = {}, set(nodes)
    for s in nodes:
        if s in lab:
            continue
        todo, lab[s] = deque([s]), s
        while todo:
            a = todo.popleft()
            for b in np.flatnonzero(g[a] > 0):
                if b in inside and b not in lab:
                    lab[b] = s
                    todo.append(b)
    return lab


def test_filtration(run, graph):
    g, real, _, _ = graph
    got = run("graph_filtration").sort_values("tau", ascending=False)
    assert len(got) == 60
    for r in got.iloc[::7].itertuples():
        cut = np.where(g >= r.tau - 1e-7, g, 0)
        own, full = parts(cut, np.flatnonzero(real).tolist()), parts(cut, list(range(len(g))))
        want = len(set(own.values())), len({full[i] for i in np.flatnonzero(real)})
        low = np.where(g >= r.tau + 1e-6, g, 0)  # a weight may lie within the rounding of tau
        other = len(set(parts(low, np.flatnonzero(real).tolist()).values()))
        assert want[0] <= r.n_comp_real <= other and r.bridge_gap == r.n_comp_real - r.n_comp_real_in_combined >= 0


def test_fiedler(run, graph):
    g, real, _, _ = graph
    got = run("graph_fiedler").set_index("nodes")["fiedler"]
    for name, w in (("real", g[np.ix_(real, real)]), ("all", g)):
        assert got[name] == pytest.approx(np.linalg.eigvalsh(np.diag(w.sum(1)) - w)[1], abs=2e-6)


def test_bottleneck(run, graph):
    g, real, grp, ids = graph
    wide = g.copy()
    for k in range(len(g)):  # widest paths through the nodes so far
        wide = np.maximum(wide, np.minimum(wide[:, k : k + 1], wide[k : k + 1]))
    first = {x: min(np.flatnonzero(real & (grp == x)), key=lambda i: ids[i]) for x in set(grp[real])}
    got = run("graph_bottleneck")
    assert len(got) == len(first) * (len(first) - 1) // 2
    for r in got.itertuples():
        assert r.bottleneck_weight == pytest.approx(wide[first[r.group_a], first[r.group_b]], abs=1e-5)


def test_islands(run, graph):
    _, real, grp, ids = graph
    got = run("graph_islands")
    assert got["size"].sum() == real.sum() and set(got["island"]) <= set(ids[real]) and set(got["dominant"]) <= set(grp[real])


def test_sobol(run):
    u = run("sample_sobol").pivot(index="i", columns="dim", values="u").to_numpy()
    assert u.shape == (64, 16) and all(sorted(c * 64) == list(range(64)) for c in u.T)


def test_volume_queries_hold_every_voxel(run, volumes):
    n = sum(len(f) for *_, f in volumes.values())
    for name in ("mask_morphology", "fn_fourier_amp", "fn_elastic", "fn_affine_aug", "fn_resolution"):
        got = run(name)
        assert len(got) == n and got["out"].between(0, 1).all()


def test_fourier_keeps_phases(volumes):
    a = volumes[0][0] * 0.2 + 0.4
    b = L.fourier_amplitude(a, 0.05, 0.25, 3)
    f, g = np.fft.fftn(a), np.fft.fftn(b)
    strong = np.abs(f) > 1e-6
    assert np.angle(g[strong] / f[strong]) == pytest.approx(0, abs=1e-6)
    assert (np.abs(g) / np.maximum(np.abs(f), 1e-12))[strong].max() <= 1.05 + 1e-6


def test_hog2d(run, volumes):
    got = run("feat_hog2d")
    for vol, (a, *_) in volumes.items():
        want = []
        for k in range(3):
            s = a.take(a.shape[k] // 2, axis=k)
            h = np.zeros((3, 3, 9))
            for i in range(s.shape[0]):
                for j in range(s.shape[1]):
                    step = lambda lo, hi, n: (lo, hi) if 0 <= lo and hi < n else ((lo + 1, hi) if lo < 0 else (lo, hi - 1))
                    (y0, y1), (x0, x1) = step(i - 1, i + 1, s.shape[0]), step(j - 1, j + 1, s.shape[1])
                    gy, gx = (s[y1, j] - s[y0, j]) / (y1 - y0), (s[i, x1] - s[i, x0]) / (x1 - x0)
                    h[min(i * 3 // s.shape[0], 2), min(j * 3 // s.shape[1], 2), min(int(np.mod(np.arctan2(gy, gx), np.pi) / np.pi * 9), 8)] += np.hypot(gy, gx)
            want.append((h / np.maximum(np.linalg.norm(h, axis=2, keepdims=True), 1e-8)).ravel())
        mine = got[got["vol"] == vol].sort_values("feature")["value"].to_numpy()
        assert np.abs(mine - np.concatenate(want)).mean() < 2e-3


def test_label_em(run, volumes):
    got = run("label_em").set_index(["vol", "i"])["label"]
    for vol, (_, _, f) in volumes.items():
        lab = got.loc[vol].reindex(f["i"]).to_numpy()
        v = f["v"].to_numpy()
        assert (lab[v <= 0.01] == 0).all() and (lab[v > 0.01] >= 1).all() and lab.max() <= 4
        means = [v[lab == k].mean() for k in range(1, 5) if (lab == k).any()]
        assert means == sorted(means)


def test_dual_mask(run, volumes):
    got = run("mask_dual").set_index(["vol", "i"])["mask"]
    for vol, (a, _, f) in volumes.items():
        pos = a[tuple(f[c] for c in "zyx")]
        t = np.quantile(pos[pos > 0], 0.03)
        env = a
        for axis in range(3):
            p = np.pad(env, [(2, 2) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
            env = sum(p.take(range(o, o + a.shape[axis]), axis=axis) for o in range(5)) / 5
        at = (f["z"], f["y"], f["x"])
        want = (a[at] > t) & (env[at] > t / 2) if (pos > 0).sum() >= 500 else a[at] > 0
        assert (got.loc[vol].reindex(f["i"]).to_numpy() == want).mean() > 0.97  # partial last slices have no dense neighbours


def test_saved_volumes(run, volumes):
    got = run("sink_nifti").set_index("vol")
    for vol, (a, *_) in volumes.items():
        d = A.Draws(42, vol)
        mm = d.between(2.0, 4.0, "mm") if d.gate(0.5, "coarse") else 1.0
        small, _ = A.coarser(a, np.eye(4), mm)
        assert tuple(got.loc[vol, "shape"])[::1] == small.shape and got.loc[vol, "total"] == pytest.approx(small.astype(np.float32).sum(dtype=float), rel=1e-4)
        assert got.loc[vol, "mm"] == pytest.approx(mm if mm > 1.01 else 1.0, abs=1e-5)


def test_training_patches(run, volumes):
    got = run("src_monai")
    assert len(got) == 512 * len(volumes) and got["v"].between(0, 1).all() and not (got["label"] == 4).any()


def test_chunk_scores(run, volumes):
    got = run("chunk_sim")
    assert len(got) == 1000 * len(volumes)
    a, _, f = volumes[0]
    v = f["v"].to_numpy()
    s = 17
    x, y = ([0.0, *sorted(host(42, t, s, k) for k in range(7)), 1.0] for t in ("edge", "value"))
    bend = [0.5 + 1.5 * host(42, "bend", s, k) for k in range(8)]
    r = []
    for q in v[v > 0]:
        k = min(max(k for k in range(9) if x[k] <= q), 7)
        r.append(y[k] + ((q - x[k]) / (x[k + 1] - x[k])) ** bend[k] * (y[k + 1] - y[k]))
    r = np.array(r)
    lo, hi = np.quantile(r, (0.3333, 0.6667))
    assert got[(got["vol"] == 0) & (got["s"] == s)]["score"].iloc[0] == pytest.approx(r[r > hi].mean() - r[r <= lo].mean(), abs=1e-5)


def test_whole_volume_generators(run, volumes):
    """Each query gives every voxel what its function gives for the volume and the volume's draws."""
    fns = {
        "tg_v8_grid": lambda a, _, d: A.grid_permute(a, d), "tg_v15_grid": lambda a, _, d: A.grid_levels(a, d),
        "fn_spatial_soft_quantile": lambda a, _, d: A.spatial_soft_quantiles(a, d), "fn_sparse_synthseg": A.sparse_labels, "fn_partial_synthseg": A.partial_labels,
        "fn_bigaug": lambda *x: A.stacked(*x)[0], "fn_kornia_pipeline": lambda *x: A.training(*x)[0],
    }
    for name, fn in fns.items():
        got = run(name).set_index(["vol", "i"])["g"]
        for vol, (a, lab, f) in volumes.items():
            want = pd.Series(fn(a, lab, A.Draws(42, vol))[f["z"], f["y"], f["x"]], f["i"])
            assert got.loc[vol].reindex(want.index).to_numpy() == pytest.approx(want.to_numpy(), abs=1e-5)


def test_multi_scale_gradient_loss(spark):
    """On volumes without a partial last slice."""
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()["loss_ms_grad"](spark, sf).toPandas().set_index("vol")["loss"]
    whole = {vol: x for vol, x in dense_volumes(sf).items() if len(x[2]) == x[0].size}
    assert len(whole) > 5

    def along(a, k, axis):
        r = len(k) // 2
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)])
        return sum(w * p.take(range(o, o + a.shape[axis]), axis=axis) for o, w in enumerate(k))

    def size(a):
        out = np.full(a.shape, 1e-6)
        for axis in range(3):
            g = a
            for b in range(3):
                g = along(g, [-1, 0, 1] if b == axis else [1, 2, 1], b)
            out += g**2
        return np.sqrt(out)

    for vol, (a, lab, _) in whole.items():
        want = 0.0
        for s, w in ((1.0, 1.0), (2.0, 1.0), (4.0, 0.5)):
            r = max(3, int(s * 4) | 1) // 2
            k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * s * s))
            k /= k.sum()
            smooth = [along(along(along(x, k, 0), k, 1), k, 2) for x in (a, a * a + lab * 0.05)]
            want += w * np.abs(size(smooth[0]) - size(smooth[1])).mean()
        assert got[vol] == pytest.approx(want, abs=1e-5)
