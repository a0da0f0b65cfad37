"""Token counts of whole texts by a trie-shared dynamic programme.

Pre-tokens are runs of characters that are not white space, each with the vocabulary's word mark before it. The
distinct pre-tokens of some MB of text go into a trie; unigram forward scores (best segmentation, and the sum over
all) are computed once per shared prefix, and each terminal keeps its number of tokens. A document's counts are
sums over its pre-tokens. Nothing is shuffled. The vocabulary is public and comes with ranks instead of probabilities;
a piece's probability falls with its rank (``lattice.zipf``), as tokenizers are not trained here.

Defined results: null and empty texts have no tokens; equal rows get equal counts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm import lattice
from scanframe.llm.common import batch_rows

#: UTF-8 bytes of text whose pre-tokens share a trie.
SHARE_BYTES = 4 << 20


def by_text_blocks(batches: Iterator[pa.RecordBatch], limit: int = SHARE_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about limit characters at a time."""
    ids, texts, held = [], [], 0
    for i, t in batch_rows(batches):
        ids.append(i)
        texts.append(t)
        held += len(t or "")
        if held >= limit:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def word_ids(texts: list[str | None], fold: Callable[[str], str] = lambda t: t) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as places in them, and each text's number of words."""
    each = [fold(t).encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    n = np.fromiter(map(len, each), np.int64, len(each))
    flat = [w for ws in each for w in ws]
    distinct = list(set(flat))
    place = {w: k for k, w in enumerate(distinct)}
    return distinct, np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)), n


def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of values (one row per word) over each text's words."""
    out = np.zeros((len(n), *values.shape[1:]), values.dtype)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some], axis=0)
    return out


def token_counts(docs: DataFrame, vocabulary: str = lattice.VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, best_score and forward_score (natural logs) of every document."""
    spark = docs.sparkSession
    vocab = lattice.pieces(vocabulary)
    shared = spark.sparkContext.broadcast(lattice.Lattice(vocab, lattice.zipf(len(vocab))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, texts in by_text_blocks(batches):
            distinct, at, n = word_ids(texts)
            marked = [lattice.MARK + w for w in distinct]
            best, count, total = model.best(marked, total=True)
            exact = per_text(count[at], n)
            scores = per_text(np.stack([best, total], axis=1)[at].round(9), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), pa.array(exact), pa.array(scores[:, 0]), pa.array(scores[:, 1])],
                names=["doc_id", "n_pretokens", "n_tokens", "best_score", "forward_score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, best_score double, forward_score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
