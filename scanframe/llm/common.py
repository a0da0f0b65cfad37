"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.session import materialize, shared_dir

__all__ = ["WS", "batch_rows", "bucket_count", "held_out", "join_salted", "materialize", "once", "read_table", "row_key", "shared_dir"]

#: White space as the contracts define it: \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def row_key(doc_id: Column, text: Column) -> Column:
    """A key that tells rows of one doc_id apart by their text; rows equal in both share it."""
    return F.xxhash64(doc_id.cast("string"), text)


def bucket_count(df: DataFrame, per_bucket: int, size: Column | None = None) -> int:
    """Buckets of about per_bucket rows (or units of size): grows with the input."""
    n = df.agg(F.sum(size) if size is not None else F.count(F.lit(1))).first()[0] or 0
    return max(1, math.ceil(n / per_bucket))


def batch_rows(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples. Spark bounds a batch by bytes; only a few rows at a time become Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(k, step).columns), strict=True)


def once(d: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator, into which no filter is pushed and with which no projection
    is merged, so that no later lambda or condition computes value again."""
    return d.withColumn(name, F.explode(F.array(value)))


#: A key is hot if it holds over one in so many of all rows; so there are fewer hot keys than this, whatever the data.
HOT_SHARE = 10_000


def join_salted(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined to table (one row per key; n: the rows that have it) with the rows of hot keys dealt over many tasks.

    Hot keys are broadcast with their number of salts: fewer than HOT_SHARE keys and twice as many salts by arithmetic.
    spread tells rows of one key apart."""
    total = table.agg(F.sum("n")).first()[0] or 0
    salts = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total))).cast("int")
    hot = table.where(F.col("n") * HOT_SHARE > total).select(key, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    copies = F.when(F.col("n") * HOT_SHARE > total, salts).otherwise(1)
    wide = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(wide, [key, "_salt"], how).drop("_salt")
