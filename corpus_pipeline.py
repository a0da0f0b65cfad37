"""A training-data pipeline over the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns they got.

Rows: a stage keeps repeated rows apart unless its operator says otherwise. Languages rejected are texts without a
letter and those of which no language holds half of the probability. A text of which line dedup leaves nothing
goes. Of a near-duplicate group the row with the least doc_id stays. A document with any benchmark window goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm import decontam, langid, line_dedup, mixing, ngram_join
from scanframe.llm.common import WS, materialize, row_key


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("string").alias("id"), row_key(F.col("doc_id"), F.col("text")).alias("key"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is known to be in one of the languages of the labelled documents; no shuffle of texts."""
    out = langid.predict(docs, langid.fit(docs), {"row": F.struct("*")})
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, where there is such a column, is counted anew."""
    out = line_dedup.line_dedup(docs).where((F.col("n_removed") <= 0) | (F.btrim("text", F.lit(WS)) != ""))
    new = {"text": F.col("text")} | {f.name: F.length("text").cast(f.dataType) for f in docs.schema if f.name == "n_chars"}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    j = ngram_join.ngram_join(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("class_key")))
    heads = j.select(F.col("doc_id").cast("string").alias("id"), "key")
    kept = _keyed(docs).alias("d").join(heads.alias("h"), _same("d", "h"), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select(F.col("doc_id").cast("string").alias("id"), "key")
    return _keyed(docs).alias("d").join(bad.alias("b"), _same("d", "b"), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with mix_slot, mix_place (their order in the mix) and mix_in_target."""
    m = mixing.mix(docs)
    return m.select("row.*", F.col("slot").alias("mix_slot"), F.col("place").alias("mix_place"), F.col("in_target").alias("mix_in_target"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Language ID learns a model and MinHash draws permutations, which SQL cannot express; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
