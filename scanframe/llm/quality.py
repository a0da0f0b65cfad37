"""Quality rules with thresholds learned from mergeable quantile sketches (DataFrame functions only).

The ratios of the documents that pass the base rule are summarised by sketches per (lang, source): counts in buckets whose
bounds grow by a factor, so a quantile read from them is off by ACCURACY of its value at most. A sketch is a few rows;
sketches merge by adding counts, in any order with the same result, so small groups fall back to their language's merged
sketch, then to the sketch of all. A fence lies a few spreads outside the quartiles; the spread is read from the
quartiles and from the outer tenth, for ratios that are mostly zero. Documents are joined to the thresholds of their
group and judged in one pass. Only numbers are shuffled, never texts; counts are summed before they move.

Defined results: a null text has no words (base_failed); empty tables give empty results; null lang and null
source form groups of their own; equal rows get equal verdicts, in every run; other columns of the input are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanframe.llm.common import WS, join_salted, materialize

#: Ratios judged, with the least spread that a group is taken to have.
RATIOS = {"symbol_ratio": 0.01, "dup_line_ratio": 0.03, "repeat_ratio": 0.02, "mean_word": 0.25}
#: Relative error of a quantile, and the log of the factor between bucket bounds that gives it.
ACCURACY = 0.005
STEP = math.log((1 + ACCURACY) / (1 - ACCURACY))
ZERO = -(1 << 30)
SYMBOLS = "#*$%&|<>"
_WORD_SPLIT = r"[\x20\x09-\x0D]+"
_HAS_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5


def _repeat_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the column words: words inside windows whose hash occurs twice or more."""
    at = lambda i, k: F.get(F.col("words"), i + k)
    d = d.withColumn(
        "hashes",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
        ),
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col("sorted"), j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("sorted"), j + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(F.filter("sorted", same), lambda x: x["i"]))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"))
    covered = F.aggregate("starts", zero, step, lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.when(F.col("starts").isNull(), F.lit(0)).otherwise(covered).cast("long"))


def quality_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", t.alias("t"))
    d = d.withColumn("words", F.array_remove(F.split("t", _WORD_SPLIT), ""))
    d = d.withColumn("n_words", F.size("words"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(_HAS_WORD)))
    d = _repeat_words(d)
    return d.select(
        "doc_id", "lang", "source",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate("t", WS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_ratios(m: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return m.withColumns({
        "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word": ratio("word_chars", "n_words"),
    })


def sketches(m: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, c: one sketch per ratio for each (lang, source), summed map-side."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("ratio"), F.col(c).alias("v")) for c in RATIOS]))
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log(F.col("x.v")) / STEP)).otherwise(ZERO).cast("int")
    d = m.select("lang", "source", each.alias("x")).select("lang", "source", "x.ratio", bucket.alias("bucket"))
    return d.groupBy("lang", "source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("c"))


def _merged(s: DataFrame, *by: str) -> DataFrame:
    return s.groupBy(*by, "ratio", "bucket").agg(F.sum("c").alias("c"))


def quantiles(s: DataFrame, at: tuple[float, ...], *by: str) -> DataFrame:
    """by, ratio, n and q0, q1, ...: quantiles of each sketch, whose buckets number a few thousand at most."""
    w = W.partitionBy(*by, "ratio")
    d = s.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("bucket"))})
    value = lambda b: F.when(b == ZERO, 0.0).otherwise(F.exp(b * F.lit(STEP)) * (1 - ACCURACY))
    least = {f"q{k}": F.min(F.when(F.col("upto") > (F.col("n") - 1) * q, F.col("bucket"))) for k, q in enumerate(at)}
    return d.groupBy(*by, "ratio").agg(F.max("n").alias("n"), *[value(v).alias(k) for k, v in least.items()])


def fences(s: DataFrame, spread: float, *by: str) -> DataFrame:
    """by, n, low_mean_word and high_<ratio>: quartiles of the sketch, moved outwards by spread times the larger of their distance
    and the median's distance to the outer tenth; the low one never below half of the first quartile."""
    q = quantiles(s, (0.10, 0.25, 0.50, 0.75, 0.90), *by)
    least = F.element_at(F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv]), F.col("ratio"))
    high = F.col("q3") + F.greatest(F.col("q3") - F.col("q1"), F.col("q4") - F.col("q2"), least) * spread
    low = F.greatest(F.col("q1") - F.greatest(F.col("q3") - F.col("q1"), F.col("q2") - F.col("q0"), least) * spread, F.col("q1") / 2)
    of = lambda c, v: F.max(F.when(F.col("ratio") == c, v))
    return q.groupBy(*by).agg(F.max("n").alias("n"), of("mean_word", low).alias("low_mean_word"), *[of(c, high).alias(f"high_{c}") for c in RATIOS])


def thresholds(m: DataFrame, min_group: int = 100, spread: float = 4.0) -> DataFrame:
    """lang, source, n (documents) and the fences of each group, learned from documents that pass the base rule; a group with under
    min_group of those takes its language's, then everyone's."""
    m = with_ratios(m)
    s = materialize(sketches(m.where(~base_failed())), "quality-sketches")
    bounds = ["low_mean_word", *[f"high_{c}" for c in RATIOS]]
    named = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
    own, by_lang = named(fences(s, spread, "lang", "source"), "o"), named(fences(_merged(s, "lang"), spread, "lang"), "l")
    every = named(fences(_merged(s).withColumn("all", F.lit(1)), spread, "all"), "a")
    g = m.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    j = g.join(own, F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")), "left")
    j = j.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every), F.col("all") == F.col("a_all"), "left")  # one row
    pick = lambda b: F.when(F.col("o_n") >= min_group, F.col(f"o_{b}")).when(F.col("l_n") >= min_group, F.col(f"l_{b}")).otherwise(F.col(f"a_{b}"))
    return j.select("lang", "source", "n", *[pick(b).alias(b) for b in bounds])


def judge(m: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept: false if the base rule fails or a ratio lies outside its group's fences."""
    group = F.struct(F.col("lang"), F.col("source"))
    j = join_salted(with_ratios(m).withColumn("group", group), limits.withColumn("group", group).drop("lang", "source"), "group", F.struct("doc_id", "n_words", "word_chars"))
    inside = F.col("mean_word") >= F.col("low_mean_word")
    for c in RATIOS:
        inside = inside & (F.col(c) <= F.col(f"high_{c}"))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_rules(docs: DataFrame, min_group: int = 100, spread: float = 4.0) -> DataFrame:
    """Counts, the base rule and the adaptive verdict of every document."""
    m = materialize(quality_metrics(docs), "quality")
    out = judge(m, materialize(thresholds(m, min_group, spread), "fences"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LEVELS = {"o": "lang, source", "l": "lang", "a": "'' AS lang"}


def _level_sql(name: str, by: str, spread: float) -> str:
    """Sketches, quantiles and fences of one level; written apart from the operator's expressions."""
    keys, q = by.replace("'' AS ", ""), {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}
    at = ", ".join(f"min(CASE WHEN upto > (n - 1) * {v} THEN b END) AS {k}" for k, v in q.items())
    real = ", ".join(f"CASE WHEN {k} = {ZERO} THEN 0.0 ELSE exp({k} * {STEP!r}) * {1 - ACCURACY!r} END AS {k}" for k in q)
    least = "CASE ratio " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in RATIOS.items()) + " END"
    highs = ", ".join(f"max(CASE WHEN ratio = '{c}' THEN hi END) AS {name}_{c}" for c in RATIOS)
    return f"""
{name}1 AS (SELECT {by}, ratio, b, sum(c) AS c FROM sketch GROUP BY ALL),
{name}2 AS (SELECT *, sum(c) OVER (PARTITION BY {keys}, ratio) AS n, sum(c) OVER (PARTITION BY {keys}, ratio ORDER BY b) AS upto FROM {name}1),
{name}3 AS (SELECT {keys}, ratio, max(n) AS n, {at} FROM {name}2 GROUP BY ALL),
{name}4 AS (SELECT {keys}, ratio, n, {real} FROM {name}3),
{name}5 AS (SELECT {keys}, ratio, n, q75 + greatest(q75 - q25, q90 - q50, {least}) * {spread} AS hi,
  greatest(q25 - greatest(q75 - q25, q50 - q10, {least}) * {spread}, q25 / 2) AS lo FROM {name}4),
{name} AS (SELECT {keys}, max(n) AS {name}_n, max(CASE WHEN ratio = 'mean_word' THEN lo END) AS {name}_low, {highs} FROM {name}5 GROUP BY ALL)"""


def sql(min_group: int = 100, spread: float = 4.0) -> str:
    """The whole operator in DuckDB; the ids of the tables are unique."""
    pick = lambda b: f"CASE WHEN o_n >= {min_group} THEN o_{b} WHEN l_n >= {min_group} THEN l_{b} ELSE a_{b} END"
    inside = " AND ".join([f"mean_word >= {pick('low')}", *[f"{c} <= {pick(c)}" for c in RATIOS]])
    buckets = " UNION ALL ".join(f"SELECT lang, source, '{c}' AS ratio, {c} AS v FROM r WHERE NOT base_failed" for c in RATIOS)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM t),
tok AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS k FROM w),
g AS (SELECT doc_id, k, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
h AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g WHERE s IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM h WHERE c > 1) AS x GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
  n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word FROM m),
sketch AS (SELECT lang, source, ratio, CASE WHEN v > 0 THEN ceil(ln(CASE WHEN v > 0 THEN v ELSE 1 END) / {STEP!r})::INT ELSE {ZERO} END AS b, count(*) AS c FROM ({buckets}) AS x GROUP BY ALL),
{",".join(_level_sql(k, v, spread) for k, v in _LEVELS.items())}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, TRUE) AS kept, r.lang, r.source
FROM r LEFT JOIN o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source
LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN a ON TRUE
"""
