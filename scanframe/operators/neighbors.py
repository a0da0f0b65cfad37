"""Exact nearest neighbours in blocks.

Both sides are packed into blocks of some hundred vectors per group. The pairs of a group are dealt over cells of SIDE x SIDE
blocks: a query block goes to one row of cells and a base block to one column, so a group of any size is compared in many tasks,
and a block is copied once for SIDE blocks of the other side. Without groups, and where queries belong to none, all base blocks
are dealt the same way. A cell gives each query its k best base rows; the k best of all cells come from a second, small ranking.

Inside a cell one matrix product gives all squared distances up to a bound on its rounding. Pairs that the bound cannot
settle are taken again in double precision from differences; these distances are the ones returned, so equal vectors are at 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 512
SIDE = 16
#: Base rows in one matrix product, and pairs taken from differences at a time.
CHUNK = 1024
EXACT = 1 << 16


def _counted(d: DataFrame, by: list[str], name: str) -> DataFrame:
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def pack(d: DataFrame, id_col: str, vector: str, by: list[str], prefix: str, block: int = BLOCK) -> DataFrame:
    """One row per block: group, ids and the vectors end to end. by names a column at least."""
    j = d.join(_counted(d, by, "_n"), by)
    part = F.pmod(F.xxhash64(id_col), F.greatest(F.lit(1), F.ceil(F.col("_n") / block)))
    g = j.groupBy(*by, part.alias("_part")).agg(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(vector).alias("v"))).alias("_rows"))
    return g.select(*by, F.col("_rows")["i"].alias(f"{prefix}_ids"), F.flatten(F.col("_rows")["v"]).alias(f"{prefix}_vecs"))


def _cells(queries: DataFrame, base: DataFrame, id_col: str, q_vector: str, b_vector: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of both sides, copied to the cells of their group: columns by, _row, _col."""
    cells = _counted(queries, by, "_nq").join(_counted(base, by, "_nb"), by)
    side = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / (BLOCK * SIDE))).cast("int")
    cells = cells.select(*by, side("_nq").alias("_rows"), side("_nb").alias("_cols"))
    q = pack(queries.select(*by, id_col, q_vector), id_col, q_vector, by, "q").join(cells, by)
    b = pack(base.select(*by, id_col, b_vector), id_col, b_vector, by, "b").join(cells, by)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.select(*by, "q_ids", "q_vecs", F.pmod(F.xxhash64("q_ids"), "_rows").cast("int").alias("_row"), all_of("_cols").alias("_col"))
    b = b.select(*by, "b_ids", "b_vecs", F.pmod(F.xxhash64("b_ids"), "_cols").cast("int").alias("_col"), all_of("_rows").alias("_row"))
    return q, b


def _per_cell(q: DataFrame, b: DataFrame, by: list[str], run: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """run(group, q ids, q vectors, b ids, b vectors) for every cell with blocks of both sides, rows by id."""

    def side(f: pd.DataFrame, p: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.asarray(i, np.int64) for i in f[f"{p}_ids"]])
        vecs = np.concatenate([np.asarray(v, float) for v in f[f"{p}_vecs"]]).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], vecs[order]

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            return run(dict(zip(by, key)), *side(left, "q"), *side(right, "b"))
        return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    keys = [*by, "_row", "_col"]
    # aliases are columns of their own: both sides may come from one table
    grouped = lambda d, p: d.select(*[F.col(c).alias(f"{p}_key{i}") for i, c in enumerate(keys)], f"{p}_ids", f"{p}_vecs").groupBy(*[f"{p}_key{i}" for i in range(len(keys))])
    return grouped(q, "q").cogroup(grouped(b, "b")).applyInPandas(cell, schema)


def _distances(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs (r, c) of rows, from differences."""
    parts = [np.sqrt(((y[c[i : i + EXACT]] - x[r[i : i + EXACT]]) ** 2).sum(axis=1)) for i in range(0, len(r), EXACT)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _slack(dims: int) -> float:
    """Times the sum of both squared norms: more than the rounding of a product's squared distance and of one from differences."""
    return (dims + 8) * 2.0**-49


def nearest(qi: np.ndarray, x: np.ndarray, bi: np.ndarray, y: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, base positions and distances of each query's k nearest rows of y; ties by base id. bi is ascending."""
    out, yy = [], (y * y).sum(axis=1)
    right = np.column_stack([y, np.ones(len(y)), yy])
    for s in range(0, len(x), BLOCK):
        xs, ids = x[s : s + BLOCK], qi[s : s + BLOCK]
        xx = (xs * xs).sum(axis=1)
        left = np.column_stack([-2 * xs, xx, np.ones(len(xs))])
        rows, at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(len(xs), np.inf)
        for o in range(0, len(y), CHUNK):
            near = left @ right[o : o + CHUNK].T
            if exclude_self:
                lo, hi = (np.searchsorted(bi[o : o + CHUNK], ids, e) for e in ("left", "right"))
                for j in range(int((hi - lo).max())):
                    own = np.flatnonzero(lo + j < hi)
                    near[own, lo[own] + j] = np.inf
            slack = _slack(x.shape[1]) * (xx + yy[o : o + CHUNK].max())
            if o == 0 and near.shape[1] > k:  # later chunks have the limit of those before
                limit = np.partition(near, k - 1, axis=1)[:, k - 1] + slack
            r, c = np.nonzero(~(near > (limit + slack)[:, None]))  # what is not a number is a candidate
            c = c + o
            if exclude_self:
                other = ids[r] != bi[c]
                r, c = r[other], c[other]
            if not len(r):
                continue
            d = _distances(xs, y, r, c)
            ok = np.isfinite(d)
            rows, at, dist = np.concatenate([rows, r[ok]]), np.concatenate([at, c[ok]]), np.concatenate([dist, d[ok]])
            order = np.lexsort((at, dist, rows))
            rows, at, dist = rows[order], at[order], dist[order]
            first = np.searchsorted(rows, rows)
            rank = np.arange(len(rows)) - first
            keep = rank < k
            full = rank == k - 1
            limit[rows[full]] = dist[full] ** 2
            rows, at, dist = rows[keep], at[keep], dist[keep]
        out.append((rows + s, at, dist))
    return tuple(np.concatenate(p) for p in zip(*out))


def count_within(x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per row of x: how many rows of y are nearer than their radius."""
    some = radius > 0  # no distance is under 0
    y, radius = y[some], radius[some]
    inside, yy, square = np.zeros(len(x), np.int64), (y * y).sum(axis=1), radius * radius
    right = np.column_stack([y, np.ones(len(y)), yy - square])
    for s in range(0, len(x), BLOCK):
        xs = x[s : s + BLOCK]
        xx = (xs * xs).sum(axis=1)
        left = np.column_stack([-2 * xs, xx, np.ones(len(xs))])
        for o in range(0, len(y), CHUNK):
            part = slice(o, o + CHUNK)
            over = left @ right[part].T  # squared distance less squared radius
            slack = _slack(x.shape[1]) * (xx.max() + yy[part] + square[part])
            sure = over < -slack
            r, c = np.nonzero(~sure & ~(over > slack))
            inside[s : s + BLOCK] += sure.sum(axis=1)
            inside[s : s + BLOCK] += np.bincount(r[_distances(xs, y, r, c + o) < radius[c + o]], minlength=len(xs))
    return inside


def knn(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, by: list[str] | None = None, exclude_self: bool = False, across: bool = False) -> DataFrame:
    """by, q, b, dist, rank (1..k): the k nearest base rows of each query within its group; ties by id. With across, queries
    have no group and each is compared with every group of base, whose columns by names."""
    by = by or []
    own = [] if across else by
    carried = [c for c in by if c not in own]
    if carried:  # the group of a base row is part of its id until the blocks are compared
        names = base.select(*carried).distinct().withColumn("_group", F.xxhash64(*carried))
        base = base.withColumn("_group", F.xxhash64(*carried))
    one = lambda d: d if own else d.withColumn("_all", F.lit(0))
    key = own or ["_all"]
    if not carried:
        q, b = _cells(one(queries), one(base), id_col, vector, vector, key)
    else:
        tagged = base.withColumn("_tag", F.concat(F.col(vector).cast("array<double>"), F.transform(F.array(F.shiftrightunsigned("_group", 32), F.col("_group").bitwiseAND(F.lit(0xFFFFFFFF))), lambda x: x.cast("double"))))
        q, b = _cells(one(queries), one(tagged), id_col, vector, "_tag", key)
    types = dict(q.dtypes)
    group = ["_group"] if carried else []

    def run(named: dict, qi: np.ndarray, x: np.ndarray, bi: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        tag = np.zeros(len(bi), np.int64)
        if carried:
            high, low = y[:, -2].astype(np.uint64), y[:, -1].astype(np.uint64)
            tag, y = ((high << np.uint64(32)) | low).view(np.int64), y[:, :-2]
        out = []
        for g in np.unique(tag):
            at = np.flatnonzero(tag == g)
            r, c, dist = nearest(qi, x, bi[at], np.ascontiguousarray(y[at]), k, exclude_self)
            out.append(pd.DataFrame(named | ({"_group": g} if carried else {}) | {"q": qi[r], "b": bi[at][c], "dist": dist}))
        return pd.concat(out)

    schema = ", ".join([f"{c} {types[c]}" for c in key] + ["_group bigint"] * bool(carried) + ["q bigint", "b bigint", "dist double"])
    near = _per_cell(q, b, key, run, schema)
    w = W.partitionBy(*key, *group, "q").orderBy("dist", "b")  # k rows per cell
    out = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = out if own else out.drop("_all")
    return out.join(names, "_group").drop("_group") if carried else out


def within(queries: DataFrame, base: DataFrame, id_col: str, vector: str, radius: str, by: list[str]) -> DataFrame:
    """by, q, inside: number of base rows nearer to the query than their own radius (a column of base)."""
    q, b = _cells(queries, base.withColumn("_vr", F.concat(F.col(vector).cast("array<double>"), F.array(radius))), id_col, vector, "_vr", by)
    types = dict(q.dtypes)

    def run(named: dict, qi: np.ndarray, x: np.ndarray, bi: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(named | {"q": qi, "inside": count_within(x, np.ascontiguousarray(y[:, :-1]), y[:, -1])})

    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["q bigint", "inside bigint"])
    return _per_cell(q, b, by, run, schema).groupBy(*by, "q").agg(F.sum("inside").alias("inside"))
