"""Line dedup by overlapping three-line windows.

Every run of three consecutive non-blank lines (each trimmed) is a window. A window met before, in an earlier
document (by doc_id) or earlier in the same one, is a later occurrence; the lines that later occurrences
cover are removed, overlapping ones once. Keys are MD5 digests, 128 bits.

Defined results: a null text stays null; a text of fewer than three non-blank lines is left alone; null ids
come after all others; rows equal in doc_id and text count as one document and are edited alike; blank lines
stay; all other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.llm.common import WS, join_salted, materialize, once, row_key

WINDOW = 3


def _keyed(docs: DataFrame) -> DataFrame:
    """row: the document as it came, with the id and key that name it."""
    d = docs.select(F.struct("*").alias("row"))
    return d.select("row", F.col("row.doc_id").cast("string").alias("id"), row_key(F.col("row.doc_id"), F.col("row.text")).alias("key"))


def _full(lines: Column) -> Column:
    """(position, trimmed line) of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(WS)).alias("s"))), lambda x: x["s"] != "")


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: its digest h, its place at (document, number of the window) and the positions of its lines."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"))
    d = docs.select(F.col("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").select(order.alias("doc"), "text")
    d = once(d, "full", _full(F.split("text", "\n"))).where(F.size("full") >= WINDOW)
    part = lambda i, field: [F.get(F.col("full"), i + k)[field] for k in range(WINDOW)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("full") - WINDOW),
        lambda i: F.struct(F.unhex(F.md5(F.concat_ws("\n", *part(i, "s")))).alias("h"), i.alias("w"), F.array(*part(i, "i")).alias("lines")),
    )
    d = d.select("doc", F.explode(each).alias("x"))
    return d.select(F.col("x.h").alias("h"), F.struct(F.col("doc"), F.col("x.w").alias("w")).alias("at"), F.col("x.lines").alias("lines"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """Per document (id, key): the positions of the lines that later occurrences cover, overlaps merged."""
    w = materialize(windows(docs), "windows")
    first = materialize(w.groupBy("h").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    later = join_salted(w, first, "h", F.col("at")).where(F.col("at") != F.col("first"))
    doc = [F.col("at.doc.doc_id").cast("string").alias("id"), F.col("at.doc.key").alias("key")]
    return later.groupBy(*doc).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with row (as it came), new text, n_lines (non-blank) and n_removed."""
    cover = covered_lines(docs).withColumnsRenamed({"id": "c_id", "key": "c_key"})
    d = _keyed(docs).join(cover, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")), "left")
    d = once(d, "lines", F.split(F.col("row.text"), "\n"))  # behind the shuffle, which so moves each text once
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # set difference: linear in the lines
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    full = F.filter("lines", lambda x: F.btrim(x, F.lit(WS)) != "")
    d = once(d, "new", F.struct(text.alias("text"), F.greatest(F.size(full), F.lit(0)).alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).alias("n_removed")))
    return d.select("row", "new.text", "new.n_lines", "new.n_removed")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("row.doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))


#: The ids of the tables are unique and not null.
OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
           lambda x, i: {'i': i, 's': trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))}), lambda x: x.s <> '') AS f,
         string_split(text, chr(10)) AS a FROM documents),
w AS (SELECT doc_id, f, unnest(range(1, len(f) - 1)) AS k FROM l WHERE len(f) >= 3),
k AS (SELECT doc_id, k, [f[k].i, f[k + 1].i, f[k + 2].i] AS pos, f[k].s || chr(10) || f[k + 1].s || chr(10) || f[k + 2].s AS h FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM k),
g AS (SELECT doc_id, list_distinct(flatten(list(pos))) AS gone FROM r WHERE n > 1 GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN gone IS NULL THEN array_to_string(a, chr(10))
         ELSE array_to_string(list_transform(list_filter(list_transform(a, lambda x, i: {'i': i, 's': x}), lambda x: NOT list_contains(gone, x.i)), lambda x: x.s), chr(10)) END AS text,
       len(f)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
