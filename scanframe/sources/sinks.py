"""Writers: CSV, JSON, partitioned routes, long, wide and markdown tables, NIfTI, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.sources import nifti


def csv(d: DataFrame, path: str, append: bool = False) -> None:
    d.write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def json(d: DataFrame, path: str) -> None:
    d.write.json(path)


def route(d: DataFrame, path: str, by: list[str]) -> None:
    """One folder per value of the routing columns."""
    d.write.partitionBy(*by).parquet(path)


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Rows of all shards; a column one lacks is null there."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def wide(long: DataFrame, index: list[str], key: str, value: str, keys: list[str]) -> DataFrame:
    return long.groupBy(*index).pivot(key, keys).agg(F.first(value))


def long(wide_rows: DataFrame, index: list[str], key: str = "metric", value: str = "value") -> DataFrame:
    """One row per value that is there: the other columns' names in key."""
    return wide_rows.unpivot(index, [c for c in wide_rows.columns if c not in index], key, value).where(F.col(value).isNotNull())


def _small(d: DataFrame, limit: int) -> tuple[list, str]:
    """Rows for a report, and a last line that says so if there are more."""
    rows = d.limit(limit + 1).collect()
    return rows[:limit], f"(the first {limit} rows)" if len(rows) > limit else ""


def markdown(d: DataFrame, limit: int = 200) -> str:
    """A markdown table of a small result; a longer one says that it goes on."""
    rows, more = _small(d, limit)
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [d.columns, ["---"] * len(d.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join(["| " + " | ".join(x) + " |" for x in lines] + ([more] if more else []))


def aligned(d: DataFrame, limit: int = 200) -> str:
    """An aligned text table of a small result; a longer one says that it goes on."""
    found, more = _small(d, limit)
    rows = [d.columns, *[["" if v is None else str(v) for v in r] for r in found]]
    size = [max(len(r[k]) for r in rows) for k in range(len(d.columns))]
    return "\n".join(["  ".join(v.ljust(n) for v, n in zip(r, size, strict=True)).rstrip() for r in rows] + ([more] if more else []))


def nifti_files(volumes: DataFrame, folder: str) -> DataFrame:
    """Volumes (vol, shape, affine, data) as files in a folder every executor reaches; returns vol, path, bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                raw = nifti.encode(np.asarray(r["data"], np.float32).reshape(list(r["shape"])), np.asarray(r["affine"], float).reshape(4, 4))
                path = f"{root}/vol-{r['vol']}.nii.gz"
                with store.open_output_stream(path, compression=None) as o:
                    o.write(raw)
                out.append((r["vol"], path, len(raw)))
            yield pd.DataFrame(out, columns=["vol", "path", "bytes"])

    return volumes.mapInPandas(run, "vol int, path string, bytes bigint")


def export_manifest(images: DataFrame, dataset: str) -> DataFrame:
    """Where each image and label goes in an nnU-Net folder: image and label of a case and channel."""
    case = F.concat(F.lit("/"), "case_id")
    return images.select("case_id", F.concat(F.lit(f"{dataset}/imagesTr"), case, F.lit("_"), F.lpad(F.col("channel").cast("string"), 4, "0"), F.lit(".nii.gz")).alias("image"), F.concat(F.lit(f"{dataset}/labelsTr"), case, F.lit(".nii.gz")).alias("label"))


def link_plan(folds: DataFrame, root: str) -> DataFrame:
    """One link per fold, part and subject."""
    return folds.select(F.concat_ws("/", F.lit(root), F.concat(F.lit("fold_"), "fold"), "part", "subject").alias("link"), "subject")
