"""NIfTI-1 files without a library: header fields by offset, optional gzip, one file per row."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# NIfTI-1 data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
CODES = {v: k for k, v in TYPES.items()}
SCHEMA = "path string, shape array<int>, affine array<double>, data array<float>"


def encode(a: np.ndarray, affine: np.ndarray) -> bytes:
    """A gzipped single-file NIfTI-1 image."""
    a = np.asarray(a)
    kind = a.dtype.str[1:]
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into("<2h", h, 70, CODES[kind], 8 * a.dtype.itemsize)
    struct.pack_into("<8f", h, 76, 1.0, *np.linalg.norm(affine[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", h, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", h, 252, 0, 1)
    struct.pack_into("<12f", h, 280, *affine[:3].ravel())
    h[344:348] = b"n+1\0"
    return gzip.compress(bytes(h) + a.tobytes(order="F"), mtime=0)


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(array, 4 x 4 affine), scaled as the header says, in either byte order."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    e = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    n, *shape = struct.unpack_from(e + "8h", raw, 40)
    code = struct.unpack_from(e + "h", raw, 70)[0]
    if code not in TYPES:
        raise ValueError(f"data type {code} is not supported")
    at, slope, inter = struct.unpack_from(e + "3f", raw, 108)
    affine = np.eye(4)
    if struct.unpack_from(e + "h", raw, 254)[0] > 0:
        affine[:3] = np.array(struct.unpack_from(e + "12f", raw, 280)).reshape(3, 4)
    else:
        affine[range(3), range(3)] = struct.unpack_from(e + "8f", raw, 76)[1:4]
    a = np.frombuffer(raw, e + TYPES[code], int(np.prod(shape[:n])), int(at)).reshape(shape[:n], order="F")
    return (a * (slope or 1.0) + inter).astype(np.float32), affine


def canonical(a: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes permuted and flipped so that they point right, anterior and superior."""
    m = np.abs(affine[:3, :3] / np.linalg.norm(affine[:3, :3], axis=0))
    order = [-1] * 3
    for _ in range(3):
        w, c = np.unravel_index(np.nanargmax(m), m.shape)
        order[w] = int(c)
        m[w], m[:, c] = -1, -1
    a = a.transpose(*order, *range(3, a.ndim))
    affine = affine[:, [*order, 3]].copy()
    for k in range(3):
        if affine[k, k] < 0:
            a = np.flip(a, k)
            affine[:3, 3] += affine[:3, k] * (a.shape[k] - 1)
            affine[:3, k] *= -1
    return a, affine


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per image under path: first volume of a series, canonical orientation. A broken file is a row of nulls."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                try:
                    a, affine = canonical(*decode(bytes(raw)))
                    a = a[..., 0] if a.ndim == 4 else a
                    row = (p, list(a.shape), list(affine.ravel()), a.ravel())
                except (ValueError, OSError, struct.error):
                    row = (p, None, None, None)
                yield pd.DataFrame([row], columns=["path", "shape", "affine", "data"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
