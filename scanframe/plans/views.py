"""Inputs of the queries: the driver's tables seen as scan listings, features, voxels, masks and scores.

One text per view serves both engines; only inputs are shared, the operators and their oracles are written apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "scans": """
SELECT id, sub, ses, suffix, name, '/data/' || CASE WHEN id % 11 = 0 THEN 'derivatives/' ELSE '' END || 'sub-' || sub || '/ses-' || ses || '/anat/' || name || '.nii.gz' AS path
FROM (SELECT id, sub, ses, suffix, 'sub-' || sub || '_ses-' || ses || tags || '_' || suffix AS name FROM (
  SELECT o_orderkey AS id, 'S' || lpad(CAST(o_custkey % 60 AS STRING), 3, '0') AS sub,
    CASE o_orderkey % 9 WHEN 0 THEN 'NOT1ACH' WHEN 1 THEN 'NOT2ING' WHEN 2 THEN 'NOT3GEM' WHEN 3 THEN 'NOT4GEP' WHEN 4 THEN 'OXF1PRI'
      WHEN 5 THEN 'OXF2PRI' WHEN 6 THEN 'OXF3TRI' WHEN 7 THEN 'OXF4GEP' ELSE 'LAB9NEW' END || lpad(CAST(o_custkey % 7 AS STRING), 3, '0') AS ses,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'T1w' WHEN '2' THEN 'T2w' WHEN '3' THEN 'GRE' WHEN '4' THEN 'bold' ELSE 'defacemask' END AS suffix,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CASE WHEN o_orderkey % 2 = 0 THEN '_acq-hi' ELSE '' END
      WHEN '3' THEN '_echo-' || CAST(o_orderkey % 3 + 1 AS STRING) || CASE WHEN o_orderkey % 4 < 2 THEN '_part-mag' ELSE '_part-phase' END
      WHEN '4' THEN '_task-rest_dir-AP_run-' || CAST(o_orderkey % 2 + 1 AS STRING) ELSE '' END AS tags
  FROM {orders}) AS t) AS u""",
    "synths": """
SELECT id, '/out/synthetic_v' || CAST(id % 5 AS STRING) || '/sub-' || sub || '/' || 'sub-' || sub || '_syn-' || CAST(id % 7 AS STRING) || '_run-' || CAST(id % 3 AS STRING) || '_T1w.nii.gz' AS path FROM {scans}""",
    "masks": """
SELECT replace(replace(path, '/data/', '/masks/'), '.nii.gz', '_mask.nii.gz') AS path FROM {scans} WHERE id % 5 <> 0""",
    "feats": """
SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'synth' ELSE 'real' END AS cohort, 'm' || CAST(label % 5 AS STRING) AS modality,
  's' || CAST(CAST(floor(label / 5.0) AS INT) AS STRING) AS scanner, embedding FROM {embeddings}""",
    "evals": """
SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'A' THEN 'v26_6_run1' WHEN 'N' THEN 'synthseg_a_run1' ELSE 'real_run1' END AS run_id, o_orderpriority AS contrast,
  l_linenumber % 3 + 1 AS class, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 1 - l_discount * 4 END AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "pairs": """
SELECT l_orderkey % 50 AS case_id, l_orderkey * 8 + l_linenumber AS voxel, CAST(l_discount > 0.05 AS INT) * (1 + l_linenumber % 2) AS pred, CAST(l_tax > 0.04 AS INT) * (1 + l_linenumber % 2) AS truth FROM {lineitem}""",
    "vox": """
SELECT vol, i, CAST(floor(i / 121.0) AS INT) AS z, CAST(floor(i / 11.0) AS INT) % 11 AS y, i % 11 AS x, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END AS v, label FROM (
  SELECT vol, CAST(row_number() OVER (PARTITION BY vol ORDER BY event_id) - 1 AS INT) AS i, value, min(value) OVER (PARTITION BY vol) AS lo, max(value) OVER (PARTITION BY vol) AS hi,
    CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'error' THEN 4 ELSE 0 END AS label
  FROM (SELECT CAST(floor(event_id / 1331.0) AS INT) AS vol, event_id, value, event_type FROM {events}) AS e) AS t""",
    "dirty": """
SELECT vec_id, cohort, modality, scanner, dim, CASE WHEN dim = 63 THEN NULL WHEN dim = 62 THEN 1.0 WHEN (vec_id * 7 + dim) % 97 = 0 THEN NULL ELSE v END AS v FROM {long}""",
}
#: The one view whose syntax differs: a vector's elements as rows.
_LONG = {
    "spark": "SELECT vec_id, cohort, modality, scanner, dim, CAST(v AS DOUBLE) AS v FROM {feats} LATERAL VIEW posexplode(embedding) p AS dim, v",
    "duckdb": "SELECT vec_id, cohort, modality, scanner, CAST(t.d AS INT) AS dim, CAST(embedding[t.d + 1] AS DOUBLE) AS v FROM {feats}, range(0, 64) t(d)",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    text = _LONG["spark"] if name == "long" else SQL.get(name)
    if text is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in _needs(text)})


def oracle(body: str) -> str:
    """body, DuckDB SQL that names views in braces, behind their definitions."""
    made: dict[str, str] = {}

    def add(name: str) -> None:
        text = _LONG["duckdb"] if name == "long" else SQL.get(name)
        if text is None or name in made:
            return
        for n in _needs(text):
            add(n)
        made[name] = text

    for n in _needs(body):
        add(n)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    text = plain(body).strip()
    ctes = ",\n".join(f"{k} AS ({plain(v).strip()})" for k, v in made.items())
    if not ctes:
        return text
    if re.match(r"(?i)WITH RECURSIVE\b", text):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE') :]}"
    return f"WITH {ctes},\n{text[4:]}" if re.match(r"(?i)WITH\b", text) else f"WITH {ctes}\n{text}"
