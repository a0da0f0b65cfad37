"""Augmentations and generators that need a whole volume at once, in NumPy; a task holds one scan at a time.

A volume is an array over (z, y, x). Draws of single numbers are hashes of (seed, tag, volume), so that they do not depend on
partitions; fields of noise come from a generator seeded by such a draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from scanframe.functions.rng import host, host_between
from scanframe.operators.linear import sample_at

DARK = 0.01


class Draws:
    """Numbers for one volume."""

    def __init__(self, seed: int, vol: int) -> None:
        self.seed, self.vol = seed, vol

    def u(self, tag: str, *ids: int) -> float:
        return host(self.seed, tag, self.vol, *ids)

    def between(self, lo: float, hi: float, tag: str, *ids: int) -> float:
        return host_between(lo, hi, self.seed, tag, self.vol, *ids)

    def gate(self, p: float, tag: str) -> bool:
        return self.u(tag) < p

    def field(self, tag: str) -> np.random.Generator:
        return np.random.default_rng(int(self.u(tag) * 2**32))

    def order(self, n: int, tag: str) -> np.ndarray:
        """A drawn permutation."""
        return np.argsort([self.u(tag, k) for k in range(n)], kind="stable")


def kernel(sigma: float) -> np.ndarray:
    """Gaussian over an odd number of places, six sigma wide and three at least."""
    sigma = max(sigma, 1e-3)
    size = int(max(3, round(sigma * 6)))
    size += size % 2 == 0
    g = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def radius_kernel(sigma: float, truncate: float = 3.0) -> np.ndarray:
    r = max(1, int(truncate * sigma + 0.5))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return g / g.sum()


def smooth(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Separable filter, zeros beyond the ends."""
    r = len(k) // 2
    for axis in range(3):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)])
        a = sum(w * p.take(range(o, o + a.shape[axis]), axis=axis) for o, w in enumerate(k))
    return a


def resize(a: np.ndarray, shape: tuple[int, ...], corners: bool = False) -> np.ndarray:
    """Linear along each axis. Voxels are cells (half-voxel offsets), or with corners end points that stay in place."""
    for axis, n in enumerate(shape):
        old = a.shape[axis]
        if corners:
            at = np.arange(n) * ((old - 1) / max(n - 1, 1))
        else:
            at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        lo = np.minimum(np.floor(at).astype(int), old - 1)
        hi = np.minimum(lo + 1, old - 1)
        t = (at - lo).reshape([-1 if i == axis else 1 for i in range(3)])
        a = a.take(lo, axis=axis) * (1 - t) + a.take(hi, axis=axis) * t
    return a


def nearest(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    for axis, n in enumerate(shape):
        a = a.take(np.minimum(np.arange(n) * a.shape[axis] // n, a.shape[axis] - 1), axis=axis)
    return a


# Local chunk maps


def local_edges(a: np.ndarray, chunks: int, grid: tuple[int, int, int], dark: float) -> np.ndarray:
    """(chunks + 1, ...): quantile edges of the values over dark in each cell of a grid, brought to all voxels and made to ascend."""
    pad = [(-n) % g for n, g in zip(a.shape, grid, strict=True)]
    p = np.pad(a, [(0, n) for n in pad], mode="edge")
    b = p.reshape([x for n, g in zip(p.shape, grid, strict=True) for x in (g, n // g)])
    b = b.transpose(0, 2, 4, 1, 3, 5).reshape(*grid, -1)
    edges = np.empty((chunks + 1, *grid))
    for cell in np.ndindex(*grid):
        v = b[cell][b[cell] > dark]
        edges[(slice(None), *cell)] = np.quantile(v, np.linspace(0, 1, chunks + 1)) if len(v) else dark
    edges[0], edges[-1] = np.minimum(edges[0], dark), np.maximum(edges[-1], 1.0)
    return np.maximum.accumulate(np.stack([resize(e, a.shape, corners=True) for e in edges]), axis=0)


def _chunk(a: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.clip((a[None] > edges).sum(axis=0) - 1, 0, len(edges) - 2)


def grid_permute(a: np.ndarray, draws: Draws, chunks: int = 8, grid: tuple[int, int, int] = (4, 4, 4), dark: float = DARK) -> np.ndarray:
    """Local chunks moved to each other's ranges by one drawn permutation; dark voxels stay."""
    edges = local_edges(a, chunks, grid, dark)
    k = _chunk(a, edges)
    to = np.argsort(draws.order(chunks, "perm"))[k]
    at = lambda i: np.take_along_axis(edges, i[None], axis=0)[0]
    t = (a - at(k)) / np.maximum(at(k + 1) - at(k), 1e-8)
    return np.where(a <= dark, a, np.clip(at(to) + t * (at(to + 1) - at(to)), 0, 1))


def grid_levels(a: np.ndarray, draws: Draws, chunks: int = 8, grid: tuple[int, int, int] = (4, 4, 4), dark: float = DARK) -> np.ndarray:
    """Local chunks replaced by one drawn level each; background 0."""
    levels = np.array([draws.u("level", k) for k in range(chunks)])
    return np.where(a > DARK, levels[_chunk(a, local_edges(a, chunks, grid, dark))], 0.0)


def spatial_soft_quantiles(a: np.ndarray, draws: Draws, k: int = 5, temperature: float = 0.05, noise: float = 0.02, coarse: tuple[int, int, int] = (3, 3, 3), dark: float = 1e-4) -> np.ndarray:
    """Soft assignment to k quantiles whose targets vary over space: drawn on a coarse grid, linear between."""
    a = np.clip(a, 0, 1)
    centres = np.quantile(a, (np.arange(k) + 0.5) / k)
    logit = -((a[None] - centres[:, None, None, None]) ** 2) / temperature
    w = np.exp(logit - logit.max(axis=0))
    target = draws.field("targets").random((k, *coarse))
    out = (w / w.sum(axis=0) * np.stack([resize(t, a.shape, corners=True) for t in target])).sum(axis=0)
    out = out + noise * draws.field("noise").normal(size=a.shape)
    return np.where(a <= dark, 0.0, np.clip(out, 0, 1))


# Labels replaced by textured Gaussians


def _texture(shape: tuple, draws: Draws, k: np.ndarray) -> np.ndarray:
    z = smooth(draws.field("texture").normal(size=shape), k)
    return z / max(z.std(ddof=1), 1e-8)


def sparse_labels(a: np.ndarray, labels: np.ndarray, draws: Draws, sigma: float = 1.5, classes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Voxels of the classes replaced by a drawn mean and a correlated texture, with hard edges; the rest stays, background is 0."""
    z, out = _texture(a.shape, draws, kernel(sigma)), a.astype(float).copy()
    for c in classes:
        out = np.where(labels == c, draws.u("mean", c) + draws.between(0.01, 0.1, "spread", c) * z, out)
    return np.where(a < DARK, 0.0, np.clip(out, 0, 1))


def partial_labels(a: np.ndarray, labels: np.ndarray, draws: Draws, sigma: float = 1.0, classes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """The same, blended softly into the volume at the classes' borders."""
    k = kernel(sigma)
    z = _texture(a.shape, draws, k)
    made = sum((np.where(labels == c, draws.u("mean", c) + draws.between(0.01, 0.1, "spread", c) * z, 0.0) for c in classes), np.zeros(a.shape))
    inside = np.isin(labels, classes).astype(float)
    share = smooth(inside, k)
    blend = np.clip(share, 0, 1)
    out = (1 - blend) * a + blend * smooth(made, k) / np.maximum(share, 1e-5) if inside.any() else a
    return np.where(a < DARK, 0.0, np.clip(out, 0, 1))


# Stacked augmentations

#: Ranges of the nine stacked transforms.
STACK = {
    "sharp_sigma": (0.25, 1.5), "sharp_amount": (10.0, 30.0), "blur_sigma": (0.25, 1.5), "noise_sd": (0.1, 1.0), "brightness": (-0.1, 0.1), "gamma": (0.5, 4.5),
    "scale": (-0.1, 0.1), "shift": (-0.1, 0.1), "degrees": (-20.0, 20.0), "zoom": (0.4, 1.6), "field_sigma": (10.0, 13.0), "field_amount": (0.0, 1000.0),
}
#: Chances and ranges of the training augmentations.
TRAINING = {
    "affine_p": 0.8, "rotate": 0.35, "zoom": 0.2, "elastic_p": 0.3, "elastic_sigma": (10.0, 13.0), "elastic_amount": (0.0, 300.0),
    "low_p": 0.3, "low_zoom": (0.5, 1.0), "noise_p": 0.2, "noise_sd": 0.02, "smooth_p": 0.2, "smooth_sigma": (0.5, 1.0),
}


def intensity_stack(a: np.ndarray, draws: Draws, p: float = 0.5) -> np.ndarray:
    """Sharpen, blur, noise, brightness, gamma and a linear change at half resolution, each with probability p."""
    lo, hi = a.min(), a.max()
    x = resize((a - lo) / max(hi - lo, 1e-8), tuple(max(1, n // 2) for n in a.shape))
    r = lambda name, tag="": draws.between(*STACK[name], f"{name}{tag}")
    if draws.gate(p, "on_sharp"):
        k = kernel(r("sharp_sigma"))
        once = smooth(x, k)
        x = once + (once - smooth(once, k)) * r("sharp_amount")
    if draws.gate(p, "on_blur"):
        x = smooth(x, kernel(r("blur_sigma")))
    if draws.gate(p, "on_noise"):
        x = x + draws.field("noise").normal(size=x.shape) * r("noise_sd")
    if draws.gate(p, "on_brightness"):
        x = x + r("brightness")
    if draws.gate(p, "on_gamma"):
        x = np.clip(x, 0, 1) ** r("gamma")
    if draws.gate(p, "on_linear"):
        x = x * (1 + r("scale")) + r("shift")
    return np.clip(resize(x, a.shape), 0, 1)


def _turn(angles: list[float]) -> np.ndarray:
    """Rotations about x, then y, then z, for points (x, y, z)."""
    m = np.eye(3)
    for axis, t in enumerate(angles):
        i, j = [(1, 2), (2, 0), (0, 1)][axis]
        q = np.eye(3)
        q[i, i] = q[j, j] = math.cos(t)
        q[i, j], q[j, i] = -math.sin(t), math.sin(t)
        m = q @ m
    return m


def _unit_grid(shape: tuple) -> np.ndarray:
    """Points (x, y, z) of the voxels' middles in [-1, 1]."""
    z, y, x = np.meshgrid(*[(2 * np.arange(n) + 1) / n - 1 for n in shape], indexing="ij")
    return np.stack([x, y, z])


def _sampled(a: np.ndarray, grid: np.ndarray, label: bool) -> np.ndarray:
    """a at points of the unit grid: linear with held ends, or a label's nearest voxel with 0 outside."""
    at = np.stack([((grid[2 - k] + 1) * n - 1) / 2 for k, n in enumerate(a.shape)])
    if label:
        return sample_at(a, at, nearest=True)
    return sample_at(a, np.stack([np.clip(x, 0, n - 1) for x, n in zip(at, a.shape, strict=True)]))


def _displacement(shape: tuple, draws: Draws, sigma: float, amount: float, coarse: int) -> np.ndarray:
    small = tuple(max(1, n // coarse) for n in shape)
    noise = draws.field("field").random((3, *small)) * 2 - 1
    norm = np.array([2 / max(n - 1, 1) for n in shape[::-1]]).reshape(3, 1, 1, 1)
    return np.stack([resize(smooth(x, kernel(sigma / coarse)), shape) for x in noise]) * amount * norm


def spatial_stack(a: np.ndarray, labels: np.ndarray, draws: Draws, p: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Rotation, scaling and a smooth deformation, each with probability p, in one resampling of image and label."""
    turn, scale, bend = (draws.gate(p, f"on_{t}") for t in ("turn", "zoom", "bend"))
    if not (turn or scale or bend):
        return a, labels
    m = _turn([math.radians(draws.between(*STACK["degrees"], "degrees", k)) if turn else 0.0 for k in range(3)])
    m = m @ np.diag([draws.between(*STACK["zoom"], "zoom", k) if scale else 1.0 for k in range(3)])
    grid = np.tensordot(m, _unit_grid(a.shape), 1)
    if bend:
        grid = grid + _displacement(a.shape, draws, draws.between(*STACK["field_sigma"], "field_sigma"), draws.between(*STACK["field_amount"], "field_amount"), 8)
    grid = np.clip(grid, -1, 1)
    return _sampled(a, grid, False), _sampled(labels, grid, True)


def stacked(a: np.ndarray, labels: np.ndarray, draws: Draws, p: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """All nine transforms."""
    x, y = spatial_stack(intensity_stack(a, draws, p), labels, draws, p)
    return np.clip(x, 0, 1), y


def training(a: np.ndarray, labels: np.ndarray, draws: Draws, o: dict = TRAINING) -> tuple[np.ndarray, np.ndarray]:
    """Affine and elastic moves of image and label, then low resolution, noise and smoothing of the image; each by its chance."""
    if draws.gate(o["affine_p"], "affine"):
        m = _turn([math.radians(draws.between(-o["rotate"], o["rotate"], "rotate", k)) for k in range(3)])
        m = m @ np.diag([1 / draws.between(1 - o["zoom"], 1 + o["zoom"], "zoom", k) for k in range(3)])
        grid = np.tensordot(m, _unit_grid(a.shape), 1)
        a, labels = _sampled(a, grid, False), _sampled(labels, grid, True)
    if draws.gate(o["elastic_p"], "elastic"):
        grid = _unit_grid(a.shape) + _displacement(a.shape, draws, draws.between(*o["elastic_sigma"], "elastic_sigma"), draws.between(*o["elastic_amount"], "elastic_amount"), 1)
        a, labels = _sampled(a, grid, False), _sampled(labels, grid, True)
    if draws.gate(o["low_p"], "low"):
        zoom = draws.between(*o["low_zoom"], "low_zoom")
        a = resize(nearest(a, tuple(max(1, int(n * zoom)) for n in a.shape)), a.shape)
    if draws.gate(o["noise_p"], "noise"):
        a = a + draws.field("noise_field").normal(size=a.shape) * o["noise_sd"]
    if draws.gate(o["smooth_p"], "smooth"):
        a = smooth(a, kernel(draws.between(*o["smooth_sigma"], "smooth_sigma")))
    return np.clip(a, 0, 1), labels


# Guidance maps after generation


def finish_guidance(g: np.ndarray, source: np.ndarray, draws: Draws, sigma: tuple[float, float] | list[float] = (1.0, 1.0), zoom: tuple[float, float] = (1.0, 1.0), native: bool = False, dark: float = DARK) -> np.ndarray:
    """A drawn blur (none in three of ten draws, else log-uniform; one of a list; or a fixed width), on a grid of twice the resolution or the
    native one, after a drawn loss of resolution; what is dark in source is 0."""
    if isinstance(sigma, list):
        s = sigma[min(int(draws.u("pick") * len(sigma)), len(sigma) - 1)]
    elif sigma[0] == sigma[1]:
        s = sigma[0]
    else:
        s = 0.0 if draws.gate(0.3, "plain") else math.exp(draws.between(math.log(sigma[0]), math.log(sigma[1]), "sigma"))
    z = draws.between(*zoom, "zoom")
    x = resize(g, tuple(max(1, int(n * z)) for n in g.shape)) if z < 0.99 else g
    if not native:
        x = resize(x, tuple(2 * n for n in x.shape))
    if s > 0:
        x = smooth(x, radius_kernel(s))
    x = resize(x, g.shape) if x.shape != g.shape else x
    return np.where(source < dark, 0.0, np.clip(x, 0, 1))


def coarser(a: np.ndarray, affine: np.ndarray, millimetres: float) -> tuple[np.ndarray, np.ndarray]:
    """A volume resampled to voxels of the given size, and its affine; unchanged up to 1.01 mm."""
    if millimetres <= 1.01:
        return a, affine
    scale = millimetres / max(float(np.sqrt((affine[:3, 0] ** 2).sum())), 0.5)
    out = affine.copy()
    out[:3, :3] *= scale
    return resize(a, tuple(max(1, round(n / scale)) for n in a.shape)), out


# Preprocessing of training images


def spaced(a: np.ndarray, affine: np.ndarray, size: float = 1.0, label: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Resampled to cubic voxels of the given side; the first voxel stays in place."""
    side = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    shape = tuple(int(round((n - 1) * s / size)) + 1 for n, s in zip(a.shape, side, strict=True))
    at = np.meshgrid(*[np.minimum(np.arange(n) * size / s, old - 1) for n, s, old in zip(shape, side, a.shape, strict=True)], indexing="ij")
    out = affine.copy()
    out[:3, :3] = affine[:3, :3] / side * size
    return sample_at(a, np.stack(at), nearest=label), out


def preprocess(channels: list[np.ndarray], label: np.ndarray, affine: np.ndarray, channel: int, mapping: list[tuple[int, int]], patch: tuple[int, int, int], draws: Draws) -> tuple[np.ndarray, np.ndarray]:
    """One channel and its label: spacing of 1 mm, axes to the right, front and top, labels renamed, values to [0, 1], padding to the
    patch and a drawn crop of it."""
    from scanframe.sources.nifti import canonical

    x, to = spaced(channels[channel], affine)
    y, _ = spaced(label, affine, label=True)
    x, y = canonical(x, to)[0], canonical(y, to)[0]
    named = y.copy()
    for old, new in mapping:
        named[y == old] = new
    x = (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.zeros(x.shape)
    more = [max(0, p - n) for p, n in zip(patch, x.shape, strict=True)]
    pad = [(m // 2, m - m // 2) for m in more]
    x, named = np.pad(x, pad), np.pad(named, pad)
    start = [min(int(draws.u("crop", k) * (n - p + 1)), n - p) for k, (n, p) in enumerate(zip(x.shape, patch, strict=True))]
    box = tuple(slice(s, s + p) for s, p in zip(start, patch, strict=True))
    return x[box], named[box]


# Simulated monotone maps


def monotone_maps(n: int, chunks: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges, levels (n, chunks + 1) and bends (n, chunks) of drawn monotone maps of [0, 1]."""
    inner = lambda tag: [[0.0, *sorted(host(seed, tag, s, k) for k in range(chunks - 1)), 1.0] for s in range(n)]
    return np.array(inner("edge")), np.array(inner("value")), np.array([[host_between(0.5, 2.0, seed, "bend", s, k) for k in range(chunks)] for s in range(n)])


def inversion_scores(v: np.ndarray, maps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each map: the mean of what lies over the second third of the mapped values, less that of what lies up to the first."""
    out = []
    for x, y, a in zip(*maps, strict=True):
        k = np.clip(np.searchsorted(x, v, "right") - 1, 0, len(a) - 1)
        t = np.clip((v - x[k]) / np.maximum(x[k + 1] - x[k], 1e-300), 0, 1)
        r = np.clip(y[k] + t ** a[k] * (y[k + 1] - y[k]), 0, 1)
        lo, hi = np.quantile(r, (0.3333, 0.6667))
        top = r[r > hi]
        out.append((top.mean() if len(top) else 0.0) - r[r <= lo].mean())
    return np.array(out)


#: Label-aware augmentations by name: (image, label, draws) to (image, label).
AUGMENTATIONS: dict[str, Callable] = {"bigaug": stacked, "training": training}
