"""LM scoring by prediction by partial matching (PPM, escape method C, with symbol exclusion).

A trie of byte contexts up to ORDER bytes is learned from the training rows. A symbol's probability is taken at the
longest context met in training; where the symbol is new there, an escape (distinct symbols / (occurrences +
distinct symbols)) leads to the next shorter context, whose counts then leave out the symbols already
excluded; below the empty context all 256 symbols are alike. Byte 0xFF, which no UTF-8 text has, ends a text and
fills the context at its start.

The trie lives in tables, never in one place. Texts are dealt into chunks of some MB; a chunk asks for each
distinct word and context-with-symbol once. Counts are summed per key over the corpus, code lengths of keys are
found by joins of the trie's levels, and the answers go back to the chunk that asked.

Words are keyed by 64-bit hashes: with d distinct words two share a key with a chance of about d * d / 3.7e19.

Defined results: A-Z are lowered first; a null text is the empty text (one end token); null ids count as
training rows; equal rows get equal scores; with no training rows every symbol costs log10(256); other columns
are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanframe.llm.common import bucket_count, held_out, materialize
from scanframe.llm.lattice import U64Map
from scanframe.llm.token_counts import per_text

ORDER = 4
CHUNK_BYTES = 12 << 20
_SLICE_BYTES = 1 << 20
_END = b"\xff"
WORD, GRAM = 0, 1


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_keys(words: list[bytes]) -> np.ndarray:
    """The end token is the empty word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_codes(texts: list[bytes]) -> np.ndarray:
    """For every symbol of every text, its ORDER bytes of context and itself as one number."""
    a = np.frombuffer(_END * (ORDER - 1) + b"".join(_END + t + _END * ORDER for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(a) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | a[k : len(a) - ORDER + k]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start = np.concatenate([[0], np.cumsum(size + ORDER)[:-1]])
    scored = np.ones(len(code), bool)
    for k in range(ORDER):
        gap = start + size + k
        scored[gap[gap < len(code)]] = False
    return code[scored]


def _slices(texts: list[bytes]):
    held, part = 0, []
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= _SLICE_BYTES:
            yield part
            held, part = 0, []
    if part:
        yield part


def _gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in _slices(texts):
        u, n = np.unique(gram_codes(part), return_counts=True)
        both, at = np.unique(np.concatenate([keys, u]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        keys = both
    return keys, counts


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct keys of a chunk with their counts in its training rows."""
    sides = [[lowered(t) for t in pdf["text"][pdf["held_out"] == h]] for h in (False, True)]
    counts: Counter = Counter()
    for t in sides[0]:
        counts.update(t.split())
    counts[b""] = len(sides[0])
    for t in sides[1]:
        for w in t.split():
            if w not in counts:
                counts[w] = 0
    (gk, gn), (hk, _) = map(_gram_counts, sides)
    hk = np.setdiff1d(hk, gk, assume_unique=True)
    keys = np.concatenate([word_keys(list(counts)), gk, hk]).view(np.int64)
    n = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)), gn, np.zeros(len(hk), np.int64)])
    kind = np.repeat(np.array([WORD, GRAM], np.int8), [len(counts), len(gk) + len(hk)])
    return pd.DataFrame({"chunk": np.full(len(keys), pdf["chunk"].iloc[0], np.int32), "kind": kind, "key": keys, "n": n})


def _bits(length: int) -> Column:
    return F.lit((1 << 8 * length) - 1)


def code_lengths(grams: DataFrame) -> DataFrame:
    """key, value: log10 probability of the last byte of each key after the bytes before it. grams: key, n (0: not in training)."""
    levels = {ORDER + 1: grams.where("n > 0").select(F.col("key").alias("h"), "n")}
    for size in range(ORDER, 0, -1):
        levels[size] = levels[size + 1].groupBy(F.col("h").bitwiseAND(_bits(size)).alias("h")).agg(F.sum("n").alias("n"))
    out = grams.select("key", F.when(F.col("n") > 0, F.col("n")).alias(f"n{ORDER}"))
    for j in range(ORDER, -1, -1):
        below = levels[j + 1]
        if j:
            shorter = levels[j].select(F.col("h").alias("short"), F.col("n").alias("m"))
            below = below.join(shorter, F.col("h").bitwiseAND(_bits(j)) == F.col("short"))
            node = below.groupBy(F.shiftright("h", 8).alias(f"c{j}")).agg(F.sum("n").alias(f"t{j}"), F.count("n").alias(f"d{j}"), F.sum("m").alias(f"x{j}"))
        else:
            node = below.groupBy(F.shiftright("h", 8).alias("c0")).agg(F.sum("n").alias("t0"), F.count("n").alias("d0"))
        out = out.join(node, F.shiftright(F.col("key").bitwiseAND(_bits(j + 1)), 8) == F.col(f"c{j}"), "left").drop(f"c{j}")
        if j < ORDER:
            seen = levels[j + 1].select(F.col("h").alias(f"h{j}"), F.col("n").alias(f"n{j}"))
            out = out.join(seen, F.col("key").bitwiseAND(_bits(j + 1)) == F.col(f"h{j}"), "left").drop(f"h{j}")
    plain, escaped = -F.log10(F.lit(256.0)), -F.log10(F.greatest(256 - F.col("d0"), F.lit(1)).cast("double"))
    for j in range(ORDER + 1):
        t, d, n = F.col(f"t{j}"), F.col(f"d{j}"), F.col(f"n{j}")

        def at(t: Column, d: Column, after: Column, n: Column = n) -> Column:
            return F.when(n.isNotNull(), F.log10(F.try_divide(n, t + d))).when(d == 0, after).otherwise(F.log10(F.try_divide(d, t + d)) + after)

        fresh = F.when(t.isNull(), plain).otherwise(at(t, d, escaped))
        if j < ORDER:
            come = at(t - F.col(f"x{j + 1}"), d - F.col(f"d{j + 1}"), escaped)
            out = out.withColumns({f"p{j}": fresh, f"e{j}": come})
            plain, escaped = F.col(f"p{j}"), F.col(f"e{j}")
    return out.select("key", fresh.alias("value"))


def _scorer(total: int, distinct: int):
    def answer(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = {}
        for kind in (WORD, GRAM):
            part = answers[answers["kind"] == kind]
            known[kind] = U64Map(part["key"].to_numpy(np.int64).view(np.uint64)), part["value"].to_numpy(np.float64)
        texts = [lowered(t) for t in docs["text"]]
        n, hits, base, score = [], [], [], []
        for part in _slices(texts):  # words of some texts at a time
            each = [[*t.split(), b""] for t in part]
            size = np.fromiter(map(len, each), np.int64, len(each))
            flat = [w for ws in each for w in ws]
            words = list(set(flat))
            place = {w: k for k, w in enumerate(words)}
            at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
            found, value = known[WORD]
            c = value[found.find(word_keys(words))]
            n.append(size)
            hits.append(per_text((c > 0)[at].astype(np.int64), size))
            base.append(per_text(np.log10((c + 1) / (total + distinct + 1))[at], size))
            found, value = known[GRAM]
            score.append(per_text(value[found.find(gram_codes(part))], np.fromiter((len(t) + 1 for t in part), np.int64, len(part))))
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": np.concatenate(n), "n_known": np.concatenate(hits), "train_tokens": total,
            "base_score": np.concatenate(base), "score": np.concatenate(score), "n_bytes": [len(t) for t in texts],
        })

    return answer


_OUT = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"


def lm_scores(docs: DataFrame, held: Column) -> DataFrame:
    """Scores of all rows by a model of the rows where held is false."""
    chunks = bucket_count(docs, CHUNK_BYTES, F.octet_length("text"))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.pmod(F.xxhash64(doc_id, "text"), F.lit(chunks)).cast("int").alias("chunk"), doc_id.cast("string").alias("doc_id"), held.alias("held_out"), "text")
    asked = materialize(rows.groupBy("chunk").applyInPandas(_ask, "chunk int, kind tinyint, key bigint, n bigint"), "lm-keys")
    # A chunk has a key once, so the rows of the most frequent key are no more than the chunks.
    total = materialize(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-totals")
    known = total.where(F.col("kind") == WORD)
    words = known.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    costs = code_lengths(total.where(F.col("kind") == GRAM).select("key", "n"))
    values = known.select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(costs.select(F.lit(GRAM).cast("tinyint").alias("kind"), "key", "value"))
    answers = asked.select("chunk", "kind", "key").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scorer(words[0] or 0, words[1]), _OUT).withColumn("doc_id", F.col("doc_id").cast("long"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out(F.col("doc_id"), 7))
