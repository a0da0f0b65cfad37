"""Language ID by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary. A text's likelihood is the sum over
all its segmentations into pieces, by the forward algorithm; words are scored once per shared prefix in a trie.
The languages' posteriors with equal priors give the prediction and its score.

Learned from text and lang alone, on a bounded sample: about ``max_docs`` distinct texts of each language, picked by a
hash of the text. Every language is learned, however many there are; a model takes 8 bytes for each language and piece.
Prediction covers every whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; with no language to learn from
everything is ``und``; ties go to the first language in order; null languages are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scanframe.llm import lattice
from scanframe.llm.common import held_out
from scanframe.llm.token_counts import by_text_blocks, per_text, word_ids

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def piece_counts(sample: DataFrame, vocabulary: str) -> DataFrame:
    """lang, piece, n: pieces of the best segmentations of a sample's words under rank-based probabilities."""
    vocab = lattice.pieces(vocabulary)
    shared = sample.sparkSession.sparkContext.broadcast(lattice.Lattice(vocab, lattice.zipf(len(vocab))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in by_text_blocks(batches):
            words: dict[str, Counter] = {}
            for lang, t in zip(langs, texts, strict=True):
                words.setdefault(lang, Counter()).update(t.lower().encode("utf-8", "surrogatepass").split())
            names, distinct = sorted(words), list(set().union(*words.values()))
            weights = np.array([[words[n][w] for n in names] for w in distinct], float).reshape(len(distinct), len(names))
            used = shared.value.best([lattice.MARK + w for w in distinct], weights=weights)[-1]
            piece, lang = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in lang], pa.string()), pa.array(piece, pa.int32()), pa.array(used[piece, lang].astype(np.int64))], names=["lang", "piece", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, vocabulary: str = lattice.VOCABULARY, max_docs: int = 1500, smooth: float = 0.1) -> tuple[list[str], lattice.Lattice]:
    """Languages and their lattice. What comes to the driver is at most the number of languages times the vocabulary's size."""
    labelled = train.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    seen = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    vocab = lattice.pieces(vocabulary)
    if not seen:
        return [], lattice.Lattice(vocab, lattice.zipf(len(vocab)))
    rates = train.sparkSession.createDataFrame([(r["lang"], max_docs / max(1, r["n"])) for r in seen], "lang string, rate double")
    chosen = labelled.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < F.col("rate"))  # one row per language
    langs = sorted(r["lang"] for r in seen)
    place = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((len(vocab), len(langs)))
    for r in piece_counts(chosen.dropDuplicates(["lang", "h"]), vocabulary).toLocalIterator():
        counts[r["piece"], place[r["lang"]]] = r["n"]
    return langs, lattice.Lattice(vocab, np.log((counts + smooth) / (counts + smooth).sum(axis=0)))


def predict(docs: DataFrame, model: tuple[list[str], lattice.Lattice], extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and any extra columns (made from docs) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    extra = extra or {}
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in extra.items()]).alias("id"), "text")
    fields = rows.schema["id"].dataType
    out = StructType([*fields.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, lat = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            start = 0
            while langs and start < len(texts):  # some MB at a time
                part, held, end = {}, 0, start
                while end < len(texts) and held < 4 << 20:
                    t = texts[end].as_py()
                    if t and _LETTER.search(t):
                        part[end] = t
                        held += len(t)
                    end += 1
                distinct, at, n = word_ids(list(part.values()), str.lower)
                like = per_text(lat.forward([lattice.MARK + w for w in distinct])[at], n)
                for k, x in zip(part, like, strict=True):
                    post = np.exp(x - x.max())
                    pred[k], score[k] = langs[int(x.argmax())], 1.0 / post.sum()
                start = end
            cols = [ids.field(k) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score)], names=[*fields.names, "lang_pred", "score"])

    return rows.mapInArrow(run, out)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 4)
    return predict(docs, fit(docs.where(~out)), {"held_out": out})
