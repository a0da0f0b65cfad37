"""Properties of the core operators on small volumes and tables; SQL-expressible queries are compared with DuckDB."""

import gzip
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanframe.functions import names as N
from scanframe.operators import augment as A
from scanframe.operators import linear as L
from scanframe.operators import remap as R
from scanframe.operators import sampling as S
from scanframe.operators import volume as V
from scanframe.operators import windows as Wn
from scanframe.operators.neighbors import knn
from scanframe.plans import catalog
from scanframe.sources import nifti, sinks, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(0)
    a = np.round(rng.random((6, 5, 4)), 3)
    a[0] = 0
    rows = [(0, int(z * 20 + y * 4 + x), int(z), int(y), int(x), float(v), int(z % 3)) for (z, y, x), v in np.ndenumerate(a)]
    return a, spark.createDataFrame(rows, "vol int, i int, z int, y int, x int, v double, label int")


def back(d, value="v"):
    f = d.select("z", "y", "x", value).toPandas()
    return L.dense(f, value)


def test_soft_histogram_keeps_mass(spark):
    d = spark.createDataFrame([(0, v, i % 2) for i, v in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))], "vol int, v double, m int")
    assert V.soft_histogram(d, ["vol"], 8).agg(F.sum("w")).first()[0] == pytest.approx(5, abs=1e-5)
    assert V.soft_histogram(d, ["vol"], 8, mask=F.col("m") == 0).agg(F.sum("w")).first()[0] == pytest.approx(3, abs=1e-5)


@pytest.mark.parametrize("mode", ["zero", "replicate", "reflect"])
def test_filters(cube, mode):
    a, d = cube
    k = Wn.gaussian(2, 1.0)
    pad = {"zero": "constant", "replicate": "edge", "reflect": "symmetric"}[mode]
    want = a
    for axis in range(3):
        p = np.pad(want, [(2, 2) if i == axis else (0, 0) for i in range(3)], mode=pad)
        want = sum(w * p.take(range(o, o + a.shape[axis]), axis=axis) for o, w in enumerate(k))
    assert back(Wn.filter_lines(d, k, mode)) == pytest.approx(want)


def test_gradient(cube):
    a, d = cube
    g = Wn.gradient(d)
    for axis, n in enumerate(("gz", "gy", "gx")):
        assert back(g, n) == pytest.approx(np.gradient(a, axis=axis))


@pytest.mark.parametrize("name", ["v23", "v24", "v26_6", "v26_8", "v27a", "synthseg", "legacy", "v24_nm", "v26_15", "v28_3", "v17", "v19", "v25", "v27a_bis"])
def test_generators_keep_background_and_range(cube, name):
    a, d = cube
    g = back(R.generate(d, name), "g")
    assert (g[a <= R.DARK] == 0).all() and g.min() >= -1e-9 and g.max() <= 1 + 1e-9 and np.isfinite(g).all()
    again = back(R.generate(d.repartition(7, "i"), name), "g")
    assert again == pytest.approx(g)


def test_kmeans_against_numpy(cube):
    a, d = cube
    v = a[a > R.DARK]
    r = R.kmeans_1d(d, [4], 1).first()
    m = np.linspace(v.min(), v.max(), 4)
    for _ in range(10):
        lab = np.abs(v[:, None] - m).argmin(1)
        m = np.array([v[lab == k].mean() if (lab == k).any() else m[k] for k in range(4)])
    assert r.centroids == pytest.approx(list(m))


def test_zscore(cube):
    a, d = cube
    z = back(R.zscore_foreground(d.withColumn("g", F.col("v")), "g"), "g")
    assert z[a > R.DARK].mean() == pytest.approx(0, abs=1e-9) and z[a > R.DARK].std() == pytest.approx(1, abs=1e-4)


def test_overlap_guards(spark):
    d = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 1), (2, 0, 0)], "c int, pred int, truth int")
    assert {r.c: r.dice for r in V.dice(d, ["c"], 1).collect()} == {0: None, 1: 0.0, 2: 1.0}


def test_knn(spark):
    x = np.random.default_rng(1).random((60, 3))
    d = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, g int, vec array<double>")
    got = {(r.q, r["rank"]): r.dist for r in knn(d, d, "id", "vec", 2, ["g"], exclude_self=True).collect()}
    for i in range(60):
        dist = sorted(np.linalg.norm(x[i] - x[j]) for j in range(60) if j != i and j % 2 == i % 2)
        assert (got[i, 1], got[i, 2]) == pytest.approx(tuple(dist[:2]))


def test_knn_in_cells_and_across_groups(spark, monkeypatch):
    from scanframe.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 4)
    monkeypatch.setattr(neighbors, "SIDE", 2)
    x = np.random.default_rng(2).random((70, 3))
    d = spark.createDataFrame([(i, f"g{i % 3}" if i % 7 else None, v.tolist()) for i, v in enumerate(x)], "id long, g string, vec array<double>")
    got = {(r.q, r["rank"]): r.dist for r in knn(d, d, "id", "vec", 3, exclude_self=True).collect()}
    for i in range(70):
        assert [got[i, k] for k in (1, 2, 3)] == pytest.approx(sorted(np.linalg.norm(x[i] - x[j]) for j in range(70) if j != i)[:3])
    base = d.where("g IS NOT NULL")
    found = knn(d, base, "id", "vec", 1, ["g"], across=True).collect()
    assert len(found) == 70 * 3
    for r in found:
        assert r.dist == pytest.approx(min(np.linalg.norm(x[r.q] - x[j]) for j in range(70) if j % 7 and f"g{j % 3}" == r.g))


def test_few_pairs_are_taken_from_differences(monkeypatch):
    """All distances at once cost too much (F1); products leave the few pairs that their rounding cannot settle, with the same results."""
    from scanframe.operators import neighbors

    taken, exact = [], neighbors._distances
    monkeypatch.setattr(neighbors, "_distances", lambda x, y, r, c: taken.append(len(r)) or exact(x, y, r, c))
    x = np.random.default_rng(3).normal(size=(1500, 16))
    x[700:710] = x[0]  # copies tie at 0, in the order of their ids
    ids = np.arange(1500) * 3
    dist = np.sqrt(np.stack([((x - row) ** 2).sum(axis=1) for row in x]))
    radius = np.sort(dist, axis=1)[:, 5]  # each the distance of a row: not within
    assert (neighbors.count_within(x, x, radius) == (dist < radius[None, :]).sum(axis=1)).all()
    own = dist + np.where(np.eye(1500, dtype=bool), np.inf, 0.0)
    for k in (1, 3):
        best = np.argsort(own, axis=1, kind="stable")[:, :k]
        r, c, d = neighbors.nearest(ids, x, ids, x, k, True)
        assert (c.reshape(-1, k) == best).all() and (d.reshape(-1, k) == np.take_along_axis(dist, best, axis=1)).all()
        assert (r == np.repeat(np.arange(1500), k)).all()
    assert sum(taken) < 0.05 * 3 * dist.size


def test_odd_values_in_products():
    from scanframe.operators import neighbors

    x, y = np.array([[0.0, 0.0], [1e8 + 1, 1e8]]), np.array([[1e8, 1e8], [np.nan, 0.0], [1e200, 0.0], [np.inf, 0.0], [3.0, 4.0]])
    r, c, d = neighbors.nearest(np.arange(2), x, np.arange(5), y, 2, False)
    assert list(zip(r, c)) == [(0, 4), (0, 0), (1, 0), (1, 4)] and d[0] == 5.0 and d[2] == 1.0
    assert neighbors.count_within(x, y, np.array([1.5, 1.0, 1.0, np.inf, 5.0])).tolist() == [0, 1]


def test_moments_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(40, 5))
    d = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(7)
    n, mean, cov = L.moments(d)
    assert n == 40 and mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T, bias=True))
    with pytest.raises(ValueError, match="no rows"):
        L.moments(d.limit(0))


def test_enabled_cells(spark):
    d = lambda *cells: spark.createDataFrame([(c,) for c in cells], "c string").select(N.parse_enabled(F.col("c")).alias("e"))
    assert [r.e for r in d(None, "", " YES", "1", "n", "False", "0").collect()] == [True, True, True, True, False, False, False]
    for bad in ("on", "off", "2"):
        with pytest.raises(Exception, match="not a truth value"):
            d(bad).collect()


def test_splits(spark):
    s = spark.createDataFrame([(f"S{i}",) for i in range(23)] * 2, "sub string")
    folds = S.k_folds(s, "sub", 4, 1).collect()
    assert sorted(pd.Series([r.fold for r in folds]).value_counts()) == [5, 6, 6, 6] and len(folds) == 23
    assert sorted(r.fold for r in S.k_folds(s.limit(3), "sub", 5, 1).collect()) == [0, 1, 2]
    parts = pd.Series([r.part for r in S.split_ratio(s, "sub", 0.7, 0.15, 1).collect()]).value_counts()
    assert dict(parts) == {"train": 16, "val": 3, "test": 4}


def _edges(a, chunks, grid, dark):
    """Edges of every voxel, one at a time."""
    block = [-(-n // g) for n, g in zip(a.shape, grid, strict=True)]
    cell = np.zeros((*grid, chunks + 1))
    for c in np.ndindex(*grid):
        vals = []
        for off in np.ndindex(*block):
            at = tuple(min(k * b + o, n - 1) for k, b, o, n in zip(c, block, off, a.shape, strict=True))
            if a[at] > dark:
                vals.append(a[at])
        e = [np.quantile(vals, k / chunks) if vals else dark for k in range(chunks + 1)]
        e[0], e[-1] = min(e[0], dark), max(e[-1], 1.0)
        cell[c] = e
    out = np.zeros((*a.shape, chunks + 1))
    for v in np.ndindex(*a.shape):
        pos = [k * (g - 1) / max(n - 1, 1) for k, g, n in zip(v, grid, a.shape, strict=True)]
        for corner in np.ndindex(2, 2, 2):
            at = [min(int(p) + c, g - 1) for p, c, g in zip(pos, corner, grid, strict=True)]
            out[v] += np.prod([(p - int(p)) if c else 1 - (p - int(p)) for p, c in zip(pos, corner, strict=True)]) * cell[tuple(at)]
        out[v] = np.maximum.accumulate(out[v])
    return out


def test_grid_generators():
    rng = np.random.default_rng(5)
    a = rng.random((9, 7, 6))
    a[:3] = 0
    draws = A.Draws(7, 0)
    edges = _edges(a, 5, (4, 3, 2), A.DARK)
    perm, permuted, levels = draws.order(5, "perm").tolist(), A.grid_permute(a, draws, 5, (4, 3, 2)), A.grid_levels(a, draws, 5, (4, 3, 2))
    for v in np.ndindex(*a.shape):
        e = edges[v]
        k = min(max(sum(a[v] > x for x in e) - 1, 0), 4)
        to = perm.index(k)
        t = (a[v] - e[k]) / max(e[k + 1] - e[k], 1e-8)
        assert permuted[v] == pytest.approx(a[v] if a[v] <= A.DARK else min(max(e[to] + t * (e[to + 1] - e[to]), 0), 1))
        assert levels[v] == (draws.u("level", k) if a[v] > A.DARK else 0)


def test_resize_and_smooth():
    a = np.random.default_rng(6).random((6, 5, 4))
    assert A.resize(a, a.shape) == pytest.approx(a) and A.resize(np.full((4, 4, 4), 2.0), (9, 3, 1)) == pytest.approx(2)
    assert A.resize(np.arange(4.0).reshape(4, 1, 1), (7, 1, 1), corners=True).ravel() == pytest.approx(np.arange(7) / 2)
    assert A.resize(np.arange(4.0).reshape(4, 1, 1), (2, 1, 1)).ravel() == pytest.approx([0.5, 2.5])
    one = np.zeros((9, 9, 9))
    one[4, 4, 4] = 1
    k = A.kernel(1.0)
    assert A.smooth(one, k)[4, 4] == pytest.approx(np.pad(k, 1)[:9] * k[3] ** 2) and len(k) == 7 and A.smooth(one, k).sum() == pytest.approx(1)


def test_augmentations():
    rng = np.random.default_rng(8)
    a, label = rng.random((12, 11, 10)), rng.integers(0, 4, (12, 11, 10))
    a[:4] = 0
    for vol in range(6):
        for fn in A.AUGMENTATIONS.values():
            x, y = fn(a, label, A.Draws(1, vol))
            again, _ = fn(a, label, A.Draws(1, vol))
            assert x.shape == a.shape and np.isfinite(x).all() and x.min() >= 0 and x.max() <= 1 and (x == again).all() and set(np.unique(y)) <= set(range(4))
        for fn in (A.sparse_labels, A.partial_labels):
            x = fn(a, label, A.Draws(1, vol))
            assert (x[a < A.DARK] == 0).all() and x.max() <= 1
        hard = A.sparse_labels(a, label, A.Draws(1, vol))
        assert (hard[(label == 0) & (a >= A.DARK)] == a[(label == 0) & (a >= A.DARK)]).all()
        soft = A.spatial_soft_quantiles(a, A.Draws(1, vol))
        assert (soft[a <= 1e-4] == 0).all() and 0 <= soft.min() and soft.max() <= 1
    quiet = A.partial_labels(a, np.zeros_like(label), A.Draws(1, 0))
    assert quiet == pytest.approx(np.where(a < A.DARK, 0, a))
    still, same = A.spatial_stack(a, label, A.Draws(1, 0), p=0.0)
    assert still is a and same is label
    turned, _ = A.training(a, label, A.Draws(1, 0), A.TRAINING | {f"{k}_p": 0.0 for k in ("affine", "elastic", "low", "noise", "smooth")})
    assert turned == pytest.approx(a)
    m = A._turn([0.3, -0.2, 0.9])
    assert m @ m.T == pytest.approx(np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


def test_guidance_and_saving():
    a = np.random.default_rng(9).random((8, 8, 8))
    a[0] = 0
    g = A.finish_guidance(a, a, A.Draws(1, 0), (1.0, 1.0), native=True)
    want = np.where(a < A.DARK, 0, np.clip(A.smooth(a, A.radius_kernel(1.0)), 0, 1))
    assert g == pytest.approx(want) and (A.finish_guidance(a, a, A.Draws(1, 3), (0.2, 3.0), (0.5, 1.0))[0] == 0).all()
    affine = np.diag([2.0, 2.0, 2.0, 1.0])
    small, to = A.coarser(a, affine, 4.0)
    assert small.shape == (4, 4, 4) and np.diag(to)[:3] == pytest.approx(4) and A.coarser(a, affine, 1.0)[0] is a
    ch = [a, a * 2]
    x, y = A.preprocess(ch, (a > 0.5).astype(float), np.diag([2.0, 1.0, 1.0, 1.0]), 1, [(1, 7)], (20, 8, 4), A.Draws(1, 0))
    assert x.shape == y.shape == (20, 8, 4) and x.max() <= 1 and set(np.unique(y)) <= {0, 7}
    assert (x[:2] == 0).all() and (x[-2:] == 0).all()  # 15 voxels of 1 mm in the middle of 20


def test_inversion_scores():
    v = np.random.default_rng(4).random(500)
    maps = A.monotone_maps(5, 4)
    got = A.inversion_scores(v, maps)
    for s in range(5):
        x, y, a = (m[s] for m in maps)
        r = []
        for q in v:
            k = max(i for i in range(4) if x[i] <= q)
            r.append(y[k] + ((q - x[k]) / (x[k + 1] - x[k])) ** a[k] * (y[k + 1] - y[k]))
        r = np.sort(r)
        lo, hi = np.quantile(r, (0.3333, 0.6667))
        assert got[s] == pytest.approx(r[r > hi].mean() - r[r <= lo].mean())


def test_patches_use_given_centres(cube):
    a, d = cube
    d = d.withColumn("label", F.when(F.col("z") > 2, F.col("label") + 1).otherwise(0))
    out = R.synthesise_patches(d, R.kmeans_1d(d, [3], 1), 5)
    g, z, label = back(out, "g"), back(out, "zed"), back(out, "label")
    inside = label > 0
    assert (g[~inside & (a < R.DARK)] == 0).all() and g.min() >= 0 and g.max() <= 1
    assert z[inside].mean() == pytest.approx(0, abs=1e-6) and z[inside].std() == pytest.approx(1, abs=1e-3) and (z[~inside] == 0).all()


def test_gmm_match(cube):
    a, d = cube
    g = back(R.gmm_match(d, 3), "g")
    assert (g[a <= 1e-4] == 0).all() and 0 <= g.min() and g.max() <= 1 and not np.allclose(g[a > 0], a[a > 0])
    order = np.argsort(a[a > 0])
    assert (np.diff(g[a > 0][order]) >= -1e-12).all()


def test_blur_mm(cube):
    a, d = cube
    want = a
    for axis, spacing in enumerate((2.0, 1.0, 0.8)):
        s = 1.2 / spacing
        k = Wn.gaussian(max(1, int(3 * s + 0.5)), s)
        r = len(k) // 2
        p = np.pad(want, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
        want = sum(w * p.take(range(o, o + a.shape[axis]), axis=axis) for o, w in enumerate(k))
    assert back(R.blur_mm(d, 1.2, {"z": 2.0, "y": 1.0, "x": 0.8})) == pytest.approx(want)


def test_reports_say_that_they_go_on(spark):
    d = spark.range(5)
    assert sinks.markdown(d, 3).endswith("(the first 3 rows)") and sinks.aligned(d, 5).count("\n") == 5


def test_folds_raise(spark):
    f = spark.createDataFrame([(1, 0, "train"), (1, 0, "val"), (2, 9, "val")], "id int, fold int, part string")
    with pytest.raises(ValueError, match="overlap"):
        S.check_folds(f, "id", f.limit(0), 4)
    with pytest.raises(ValueError, match="contaminated"):
        S.check_folds(f.where("part = 'val'"), "id", f.where("id = 2"), 4)
    with pytest.raises(ValueError, match="range"):
        S.check_folds(f.where("part = 'val'"), "id", f.limit(0), 4)


def test_names(spark):
    d = spark.createDataFrame([("sub-a-b_ses-1_run-2_run-3_T1w.nii.gz",), ("x.nii",)], "n string").select(N.bids_entities(F.col("n")).alias("e"))
    assert [r.e for r in d.collect()] == [{"sub": "a-b", "ses": "1", "run": "3", "suffix": "T1w"}, {"suffix": "x"}]
    with pytest.raises(Exception, match="not a session"):
        spark.createDataFrame([("ses-??",)], "s string").select(N.scanner_of_session(F.col("s"))).collect()


def test_nifti_round_trip(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    affine = np.array([[0, -2.0, 0, 5], [1.0, 0, 0, 6], [0, 0, 3.0, 7], [0, 0, 0, 1]])
    b, got = nifti.decode(nifti.encode(a, affine))
    assert (b == a).all() and (got == affine).all()
    (tmp_path / "a.nii.gz").write_bytes(nifti.encode(a, affine))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(b"broken"))
    rows = {os.path.basename(r.path): r for r in nifti.read(spark, str(tmp_path)).collect()}
    assert rows["b.nii.gz"].shape is None and rows["a.nii.gz"].shape == [3, 2, 4]
    c, turned = nifti.canonical(a, affine)
    assert (np.diag(turned)[:3] > 0).all()
    p = np.array([1, 2, 3, 1.0])
    q = np.linalg.solve(turned, affine @ p)[:3].round().astype(int)
    assert c[tuple(q)] == a[1, 2, 3]


def test_documents(spark, tmp_path):
    with pytest.raises(ValueError, match="not id"):
        tables.inline_models(spark, ["a,b"])
    (tmp_path / "r.csv").write_text("model_id,enabled\na,yes\n")
    with pytest.raises(ValueError, match="missing"):
        tables.registry_csv(spark, str(tmp_path / "r.csv"))
    (tmp_path / "f.json").write_text('[{"train": ["a", "b"], "val": ["c"]}, {"train": ["c"], "val": ["a"]}]')
    assert tables.split_json(spark, str(tmp_path / "f.json")).groupBy("part").count().orderBy("part").collect() == [("train", 3), ("val", 2)]
    assert sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string")).split("\n")[2] == "| 1 |  |"


def test_linear_algebra():
    x = np.random.default_rng(2).normal(size=(40, 5)) @ np.diag([5, 3, 1, 1, 0.1])
    p = L.Pca(x.mean(0), np.cov(x.T, bias=True))
    assert p.var == pytest.approx(np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 40)
    assert L.vendi(np.eye(7)) == pytest.approx(7) and L.vendi(np.ones((7, 2))) == pytest.approx(1)
    path = pd.DataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0)], columns=["src", "dst", "w"])
    assert L.fiedler(path, [0, 1, 2, 3]) == pytest.approx(0, abs=1e-9) and math.isnan(L.fiedler(path, [0, 1, 2]))
    b = L.bottlenecks(path, {"a": 0, "b": 2, "c": 9}).set_index(["group_a", "group_b"])
    assert tuple(b.loc["a", "b"]) == (2.0, 2) and tuple(b.loc["a", "c"]) == (0.0, -1)
    curve = L.filtration(path, pd.DataFrame({"id": [0, 1, 2], "real": [True, False, True]}), 4)
    assert list(curve["bridge_gap"]) == [0, 1, 0, 0] and curve["n_comp_real"].iloc[-1] == 1
    u = L.sobol(3, 5, 1)
    assert all(sorted(c * 32) == list(range(32)) for c in u.T)
    square = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0], [0.5, 0.5]])
    assert L.hull_coverage(square, square, 2.0) == 1 and L.hull_coverage(square, square + 9, 0.1) == 0


def test_morphology():
    a = np.zeros((9, 9, 9), bool)
    a[2:7, 2:7, 2:7] = True
    a[4, 4, 4] = False
    a[0, 0, 0] = True
    assert L.fill_holes(a)[4, 4, 4] and not L.largest(a)[0, 0, 0]
    assert L.erode(L.dilate(a))[3, 3, 3] and L.dilate(a).sum() > a.sum() > L.erode(a).sum()
    m = L.brain_mask(np.where(a, 0.8, 0.1), close=1, grow=1)
    assert m[4, 4, 4] and not m[0, 0, 0]


SAMPLE = ["cov_metrics", "prdc", "agg_first_order", "win_blur_sep", "tg_v26_6", "sample_stratified", "disc_scans", "src_json_nested", "fs_wm_ratio", "agg_hd95", "stream_extract", "src_nifti"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    by = [c for c in want.columns if want[c].dtype.kind in "iubO"]
    a, b = (f.sort_values(by).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-5)


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 200


def test_graphs_hold_every_vector(spark):
    run = lambda n: catalog.queries()[n](spark, "/root/testdata/sf0.1").toPandas()
    n = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 4 <> 0").count()
    assert run("graph_islands")["size"].sum() == n
    assert n - 5 < run("graph_filtration")["n_comp_real"].max() <= n


def test_fiedler_of_large_graphs():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 700, (2, 4000))
    e = pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "w": rng.uniform(0.1, 1, 4000)}).query("src < dst").drop_duplicates(["src", "dst"])
    ring = pd.DataFrame({"src": range(700), "dst": [*range(1, 700), 0], "w": 1e-3})
    e = pd.concat([e, ring]).drop_duplicates(["src", "dst"])
    g = np.zeros((700, 700))
    g[e["src"], e["dst"]] = e["w"]
    g += g.T
    assert L.fiedler(e, list(range(700))) == pytest.approx(np.linalg.eigvalsh(np.diag(g.sum(1)) - g)[1], abs=1e-6)
    assert L.fiedler(e, list(range(701))) == 0
