"""Queries on whole-volume augmentations, preprocessing and saved volumes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanframe.operators import augment as A
from scanframe.operators import remap as R
from scanframe.operators.linear import dense, per_volume
from scanframe.plans.catalog import query
from scanframe.session import shared_dir
from scanframe.sources import nifti, sinks

SEED = 42


def _each(fn, both: bool = False):
    """Rows (vol, i, g[, label]) from a function of one volume, its labels and its draws."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        vol, at = int(f["vol"].iloc[0]), (f["z"], f["y"], f["x"])
        got = fn(dense(f), dense(f, "label"), A.Draws(SEED, vol))
        image, label = got if both else (got, None)
        out = {"vol": f["vol"], "i": f["i"], "g": np.round(image[at].astype(float), 6)}
        return pd.DataFrame(out | ({"label": label[at].astype(int)} if both else {}))

    return run


_G, _GL = "vol int, i int, g double", "vol int, i int, g double, label int"


def _register(name: str, fn, both: bool = False) -> None:
    query(name, "vox")(lambda vox: per_volume(vox, _each(fn, both), _GL if both else _G))


_register("tg_v8_grid", lambda a, _, d: A.grid_permute(a, d))
_register("tg_v15_grid", lambda a, _, d: A.grid_levels(a, d))
_register("fn_spatial_soft_quantile", lambda a, _, d: A.spatial_soft_quantiles(a, d))
_register("fn_sparse_synthseg", A.sparse_labels)
_register("fn_partial_synthseg", A.partial_labels)
_register("fn_bigaug", A.stacked, both=True)
_register("fn_kornia_pipeline", A.training, both=True)


@query("fn_guidance_post", "vox")
def fn_guidance_post(vox):
    """A generated map, blurred by a drawn width at twice the resolution after a drawn loss of resolution."""
    d = R.generate(vox, "v26_6").withColumn("source", F.col("v"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = A.finish_guidance(dense(f, "g"), dense(f, "source"), A.Draws(SEED, int(f["vol"].iloc[0])), (0.25, 2.0), (0.5, 1.0))
        return pd.DataFrame({"vol": f["vol"], "i": f["i"], "g": np.round(out[f["z"], f["y"], f["x"]], 6)})

    return per_volume(d, run, _G)


def _place(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/volumes-{uuid.uuid4().hex}"


@query("sink_nifti", "vox")
def sink_nifti(vox):
    """Volumes saved at drawn voxel sizes (1 mm for half of them, else 2 to 4 mm) and read back."""
    spark, p = vox.sparkSession, _place(vox.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        draws = A.Draws(SEED, int(f["vol"].iloc[0]))
        a, affine = A.coarser(dense(f), np.eye(4), draws.between(2.0, 4.0, "mm") if draws.gate(0.5, "coarse") else 1.0)
        return pd.DataFrame({"vol": [draws.vol], "shape": [list(a.shape)], "affine": [affine.ravel().tolist()], "data": [a.ravel().astype(np.float32)]})

    packed = per_volume(vox, run, "vol int, shape array<int>, affine array<double>, data array<float>")
    if not sinks.nifti_files(packed, p).agg(F.sum("bytes")).first()[0]:
        return spark.createDataFrame([], "vol int, shape array<int>, mm double, total double")
    d = nifti.read(spark, p)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return d.select(F.regexp_extract("path", r"vol-(\d+)", 1).cast("int").alias("vol"), "shape", F.round(F.abs(F.col("affine")[0]), 6).alias("mm"), F.round(total, 4).alias("total"))


@query("src_monai", "vox")
def src_monai(vox):
    """Training patches of 8 x 8 x 8: the second of two channels, voxels of 1.5 x 1 x 1 mm with one axis turned."""
    affine = np.array([[-1.5, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1]])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        vol, a = int(f["vol"].iloc[0]), dense(f)
        x, y = A.preprocess([a, 1 - a], dense(f, "label"), affine, 1, [(4, 3)], (8, 8, 8), A.Draws(SEED, vol))
        z, r, c = np.indices(x.shape)
        return pd.DataFrame({"vol": vol, "z": z.ravel(), "y": r.ravel(), "x": c.ravel(), "v": np.round(x.ravel(), 6), "label": y.ravel().astype(int)})

    return per_volume(vox, run, "vol int, z int, y int, x int, v double, label int")


@query("chunk_sim", "vox")
def chunk_sim(vox):
    """Inversion scores of 1000 drawn monotone maps over the foreground of every volume."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = A.monotone_maps(1000)
        for f in frames:
            for vol, v in zip(f["vol"], f["v"], strict=True):
                yield pd.DataFrame({"vol": vol, "s": np.arange(1000), "score": np.round(A.inversion_scores(np.asarray(v, float), maps), 6)})

    return vox.where("v > 0").groupBy("vol").agg(F.collect_list("v").alias("v")).mapInPandas(run, "vol int, s bigint, score double")
