"""Dense linear algebra, graphs and images of bounded size in NumPy; sums over rows stay in Spark.

Covariances are d x d and come from sums over all rows; volumes and graphs given to one task are bounded by the
size of one scan or of one group's sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(d: DataFrame, vector: str = "vec", where: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and population covariance: every partition sends its sums, of the size of the covariance."""
    rows = d if where is None else d.where(where)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_numpy()).astype(float)
                n, s, q = n + len(x), (x.sum(0) if s is None else s + x.sum(0)), (x.T @ x if q is None else q + x.T @ x)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    parts = rows.select(vector).mapInPandas(run, "n bigint, s array<double>, q array<double>")
    # element by element, summed map-side before the one row of sums is made
    each = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "q")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("all")).first()["all"]
    if not one:
        raise ValueError("no rows to take moments of")
    size = int((math.isqrt(4 * len(one) - 3) - 1) // 2)  # 1 + d + d * d numbers
    n, s, q = int(one[0]), np.array(one[1 : size + 1]), np.array(one[size + 1 :])
    mean = s / n
    return n, mean, q.reshape(size, size) / n - np.outer(mean, mean)


class Pca:
    """Axes by falling variance; of each axis the largest loading is positive. Projections are centred on the fit."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray) -> None:
        w, v = np.linalg.eigh(cov)
        order = np.argsort(w)[::-1]
        self.mean, self.var, v = mean, np.maximum(w[order], 0), v[:, order]
        self.axes = v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1, 1)
        self.ratio = self.var / max(self.var.sum(), 1e-300)

    def count(self, share: float, least: int = 3) -> int:
        """Components for at least so much of the variance."""
        return min(len(self.var), max(least, int(np.searchsorted(np.cumsum(self.ratio), share - 1e-12)) + 1))

    def project(self, d: DataFrame, k: int, vector: str = "vec", name: str = "pc") -> DataFrame:
        """Matrix product as an expression: k x d literals, no Python per row."""
        cols = []
        for j in range(k):
            axis = F.array(*[F.lit(float(x)) for x in self.axes[:, j]])
            cols.append(F.aggregate(F.zip_with(F.col(vector), axis, lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) - float(self.mean @ self.axes[:, j]))
        return d.withColumn(name, F.array(*cols))


def pca(d: DataFrame, vector: str = "vec", where: str | None = None) -> Pca:
    return Pca(*moments(d, vector, where)[1:])


def lda(d: DataFrame, label: str, vector: str = "vec", n: int = 2, ridge: float = 1e-6) -> tuple[list, np.ndarray]:
    """Classes and discriminant axes: generalised eigenvectors of between- against within-class scatter."""
    total, mean, cov = moments(d, vector)
    c = d.select(label, F.posexplode(vector).alias("dim", "v")).groupBy(label, "dim").agg(F.avg("v").alias("v"), F.count("v").alias("n")).collect()  # classes x elements
    classes = sorted({r[label] for r in c})
    means, size = np.zeros((len(classes), len(mean))), np.zeros(len(classes))
    for r in c:
        means[classes.index(r[label]), r["dim"]], size[classes.index(r[label])] = r["v"], r["n"]
    between = sum(k / total * np.outer(m - mean, m - mean) for m, k in zip(means, size, strict=True))
    within = cov - between + ridge * np.eye(len(mean))
    chol = np.linalg.inv(np.linalg.cholesky(within))
    w, v = np.linalg.eigh(chol @ between @ chol.T)
    k = min(n, len(classes) - 1)
    axes = chol.T @ v[:, np.argsort(w)[::-1][:k]]
    return classes, axes * np.where(axes[np.abs(axes).argmax(0), range(k)] < 0, -1, 1)


def vendi(x: np.ndarray) -> float:
    """exp of the entropy of the eigenvalues of the cosine Gram matrix over n."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    w = np.linalg.eigvalsh(u @ u.T / len(u))
    w = w[w > 1e-12]
    return float(np.exp(-(w * np.log(w)).sum()))


def vendi_scores(d: DataFrame, by: list[str], vector: str = "vec") -> DataFrame:
    """One score per group; groups are samples of bounded size."""
    types = dict(d.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [f[c].iloc[0]] for c in by}, "n": [len(f)], "vendi": [vendi(np.stack(f[vector].to_numpy()).astype(float)) if len(f) > 1 else None]})

    return d.select(*by, vector).groupBy(*by).applyInPandas(run, ", ".join([f"{c} {types[c]}" for c in by] + ["n bigint", "vendi double"]))


class Union:
    def __init__(self, nodes) -> None:
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def filtration(f: pd.DataFrame, nodes: pd.DataFrame, steps: int = 60) -> pd.DataFrame:
    """tau from the greatest weight to 0: components of real nodes alone, and components real nodes fall into with all edges."""
    real = set(nodes.loc[nodes["real"], "id"])
    edges = f.sort_values("w", ascending=False).to_numpy()
    own, full = Union(real), Union(nodes["id"])
    alone, k, out = len(real), 0, []
    for tau in np.linspace(f["w"].max(), 0, steps):
        while k < len(edges) and edges[k][2] >= tau and edges[k][2] > 0:
            a, b, _ = edges[k]
            full.join(a, b)
            if a in real and b in real:
                alone -= own.join(a, b)
            k += 1
        both = len({full.find(n) for n in real})
        out.append((float(tau), alone, both, alone - both))
    return pd.DataFrame(out, columns=["tau", "n_comp_real", "n_comp_real_in_combined", "bridge_gap"])


def fiedler(edges: pd.DataFrame, nodes: list) -> float:
    """Second least eigenvalue of the Laplacian; NaN under four nodes. Large graphs are not made dense."""
    if len(nodes) < 4:
        return float("nan")
    at = {n: i for i, n in enumerate(nodes)}
    if len(nodes) > 500:
        return _fiedler_sparse(edges["src"].map(at).to_numpy(), edges["dst"].map(at).to_numpy(), edges["w"].to_numpy(), len(nodes))
    g = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges[["src", "dst", "w"]].itertuples(index=False):
        g[at[a], at[b]] = g[at[b], at[a]] = w
    return float(np.linalg.eigvalsh(np.diag(g.sum(1)) - g)[1])


def _fiedler_sparse(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, steps: int = 200) -> float:
    """0 for an unconnected graph, else by Lanczos steps beside the constant vector, restarted from the best vector."""
    u, parts = Union(range(n)), n
    for x, y in zip(a[w > 0].tolist(), b[w > 0].tolist(), strict=True):
        parts -= u.join(x, y)
    if parts > 1:
        return 0.0
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    v = np.random.default_rng(0).normal(size=n)
    while True:
        q, alpha, beta = np.zeros((min(steps, n - 1), n)), [], []
        v -= v.mean()
        for k in range(len(q)):
            q[k] = v / np.linalg.norm(v)
            v = degree * q[k] - np.bincount(a, w * q[k][b], n) - np.bincount(b, w * q[k][a], n)
            alpha.append(q[k] @ v)
            for _ in range(2):
                v -= v.mean()
                v -= q[: k + 1].T @ (q[: k + 1] @ v)
            beta.append(np.linalg.norm(v))
            if beta[-1] < 1e-10:
                break
        m = len(alpha)
        value, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
        if beta[-1] * abs(s[-1, 0]) < 1e-7:
            return float(value[0])
        v = s[:, 0] @ q[:m]


def bottlenecks(edges: pd.DataFrame, reps: dict[str, int]) -> pd.DataFrame:
    """Between each two representatives: the least weight and the hops of their path in the maximum spanning tree; 0 and -1 without one."""
    nodes = set(edges["src"]) | set(edges["dst"]) | set(reps.values())
    u, tree = Union(nodes), {n: [] for n in nodes}
    for a, b, w in sorted(edges[["src", "dst", "w"]].itertuples(index=False), key=lambda e: (-e[2], e[0], e[1])):
        if w > 0 and u.join(a, b):
            tree[a].append((b, w))
            tree[b].append((a, w))
    out = []
    names = sorted(reps)
    for i, g in enumerate(names):
        best, todo = {reps[g]: (float("inf"), 0)}, [reps[g]]
        for n in todo:
            for m, w in tree[n]:
                if m not in best:
                    best[m] = min(best[n][0], w), best[n][1] + 1
                    todo.append(m)
        out += [(g, h, *(best.get(reps[h], (0.0, -1)))) for h in names[i + 1 :]]
    return pd.DataFrame(out, columns=["group_a", "group_b", "bottleneck_weight", "path_hops"])


def hull_coverage(real: np.ndarray, synth: np.ndarray, eps: float, cells: int = 60) -> float:
    """Share of grid points inside the convex hull of real (two columns) within eps of a generated point."""
    pts = sorted(map(tuple, np.unique(real, axis=0)))

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(pts) + chain(pts[::-1]))
    gx, gy = (np.linspace(real[:, k].min(), real[:, k].max(), cells) for k in range(2))
    grid = np.stack(np.meshgrid(gx, gy), -1).reshape(-1, 2)
    nxt = np.roll(hull, -1, axis=0)
    inside = np.ones(len(grid), bool)
    for (ax, ay), (bx, by) in zip(hull, nxt, strict=True):
        inside &= (bx - ax) * (grid[:, 1] - ay) - (by - ay) * (grid[:, 0] - ax) >= -1e-12
    g = grid[inside]
    if not len(g):
        return float("nan")
    near = np.array([((synth - p) ** 2).sum(1).min() for p in g])
    return float((near <= eps * eps).mean())


def dense(f: pd.DataFrame, value: str = "v") -> np.ndarray:
    out = np.zeros(tuple(f[a].max() + 1 for a in ("z", "y", "x")))
    out[f["z"], f["y"], f["x"]] = f[value]
    return out


def _shifts(a: np.ndarray) -> list[np.ndarray]:
    p = np.pad(a, 1)
    return [p[1 + dz : p.shape[0] - 1 + dz, 1 + dy : p.shape[1] - 1 + dy, 1 + dx : p.shape[2] - 1 + dx] for dz, dy, dx in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]


def dilate(a: np.ndarray, n: int = 1) -> np.ndarray:
    for _ in range(n):
        a = np.logical_or.reduce(_shifts(a))
    return a


def erode(a: np.ndarray, n: int = 1) -> np.ndarray:
    for _ in range(n):
        a = np.logical_and.reduce(_shifts(a))
    return a


def components(a: np.ndarray) -> np.ndarray:
    """Labels of face-connected parts, 0 outside: the greatest index spreads until nothing changes."""
    lab = np.where(a, np.arange(1, a.size + 1).reshape(a.shape), 0)
    while True:
        new = np.where(a, np.maximum.reduce(_shifts(lab)), 0)
        if (new == lab).all():
            return lab
        lab = new


def largest(a: np.ndarray) -> np.ndarray:
    lab = components(a)
    ids, n = np.unique(lab[lab > 0], return_counts=True)
    return lab == ids[n.argmax()] if len(ids) else a


def fill_holes(a: np.ndarray) -> np.ndarray:
    outside = components(~np.pad(a, 1))
    return ~(outside == outside[0, 0, 0])[1:-1, 1:-1, 1:-1]


def brain_mask(a: np.ndarray, scale: float = 1.0, close: int = 5, grow: int = 2) -> np.ndarray:
    """Otsu threshold times scale, closing, largest part, holes filled in the volume and in each slice, dilation."""
    h, e = np.histogram(a, 256)
    mid = (e[1:] + e[:-1]) / 2
    w0, s0 = np.cumsum(h), np.cumsum(h * mid)
    with np.errstate(all="ignore"):
        between = np.nan_to_num(w0 * (w0[-1] - w0) * (s0 / w0 - (s0[-1] - s0) / (w0[-1] - w0)) ** 2)
    m = a > mid[between.argmax()] * scale
    m = erode(np.pad(dilate(np.pad(m, close), close), 0), close)[close:-close, close:-close, close:-close]
    m = fill_holes(largest(m))
    m = np.stack([fill_holes(s[None])[0] for s in m])
    return dilate(m, grow)


def fourier_amplitude(a: np.ndarray, strength: float, box: float, seed: int) -> np.ndarray:
    """Amplitudes outside a centred low-frequency box scaled by draws; phases stay."""
    f = np.fft.fftshift(np.fft.fftn(a))
    low = np.ones(a.shape, bool)
    for k, n in enumerate(a.shape):
        r = np.abs(np.arange(n) - n // 2) <= max(1, int(n * box / 2))
        low &= r.reshape([-1 if i == k else 1 for i in range(3)])
    f = f * np.where(low, 1.0, 1 + strength * (2 * np.random.default_rng(seed).random(a.shape) - 1))
    return np.clip(np.real(np.fft.ifftn(np.fft.ifftshift(f))), 0, 1)


def sample_at(a: np.ndarray, at: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Values at fractional places (3, ...), linear or nearest, zeros outside."""
    if nearest:
        k = np.rint(at).astype(int)
        ok = np.all([(k[i] >= 0) & (k[i] < a.shape[i]) for i in range(3)], axis=0)
        return np.where(ok, a[tuple(np.clip(k[i], 0, a.shape[i] - 1) for i in range(3))], 0)
    lo = np.floor(at).astype(int)
    out = np.zeros(at.shape[1:])
    for c in range(8):
        k = [lo[i] + (c >> i & 1) for i in range(3)]
        w = np.prod([1 - np.abs(at[i] - k[i]) for i in range(3)], axis=0)
        ok = np.all([(k[i] >= 0) & (k[i] < a.shape[i]) for i in range(3)], axis=0)
        out += np.where(ok, w * a[tuple(np.clip(k[i], 0, a.shape[i] - 1) for i in range(3))], 0)
    return out


def affine_places(shape: tuple, seed: int, angle: float = 0.35, zoom: tuple = (0.7, 1.4)) -> np.ndarray:
    """Where each output voxel comes from: drawn rotations about the centre and drawn scale."""
    r = np.random.default_rng(seed)
    m = np.eye(3)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        t, q = r.uniform(-angle, angle), np.eye(3)
        q[i, i] = q[j, j] = np.cos(t)
        q[i, j], q[j, i] = -np.sin(t), np.sin(t)
        m = m @ q
    m = m / r.uniform(*zoom)
    mid = (np.array(shape) - 1).reshape(3, 1, 1, 1) / 2
    return np.tensordot(m, np.indices(shape) - mid, 1) + mid


def elastic_places(shape: tuple, seed: int, amount: float = 2.0, passes: int = 8) -> np.ndarray:
    """Identity plus a drawn displacement, smoothed by repeated neighbour means."""
    d = np.random.default_rng(seed).uniform(-1, 1, (3, *shape))
    for _ in range(passes):
        d = np.stack([np.mean(_shifts(x), axis=0) for x in d])
    return np.indices(shape) + amount * d / max(np.abs(d).max(), 1e-9)


def hog2d(image: np.ndarray, cells: int, orientations: int = 9) -> np.ndarray:
    """Orientation histograms of cells, each L2-normalised."""
    gy, gx = (np.gradient(image, axis=k) if image.shape[k] > 1 else np.zeros(image.shape) for k in range(2))
    mag, ang = np.hypot(gy, gx), np.mod(np.arctan2(gy, gx), np.pi)
    o = np.minimum((ang / np.pi * orientations).astype(int), orientations - 1)
    h = np.zeros((cells, cells, orientations))
    iy, ix = (np.minimum(np.arange(n) * cells // n, cells - 1) for n in image.shape)
    np.add.at(h, (iy[:, None].repeat(image.shape[1], 1), ix[None].repeat(image.shape[0], 0), o), mag)
    return (h / np.maximum(np.linalg.norm(h, axis=2, keepdims=True), 1e-8)).ravel()


def sobol(dims: int, bits: int, seed: int) -> np.ndarray:
    """2**bits points: a digital net from upper-triangular binary matrices drawn per dimension, with a digital shift.
    Each coordinate alone takes every multiple of 2**-bits once."""
    r = np.random.default_rng(seed)
    n = np.arange(1 << bits)
    out = np.zeros((1 << bits, dims))
    for d in range(dims):
        cols = [(1 << (bits - 1 - k)) | (int(r.integers(0, 1 << k)) << (bits - k) if k else 0) for k in range(bits)]
        x = np.zeros(1 << bits, np.int64)
        for k, c in enumerate(cols):
            x ^= np.where(n >> k & 1, c, 0)
        out[:, d] = (x ^ int(r.integers(0, 1 << bits))) / (1 << bits)
    return out


def per_volume(d: DataFrame, fn, schema: str) -> DataFrame:
    """fn(frame of one volume) -> frame. A task holds one scan at a time."""
    return d.groupBy("vol").applyInPandas(fn, schema)
