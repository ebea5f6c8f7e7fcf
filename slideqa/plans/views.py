"""The library's input tables, derived from the TPC-H-like test tables.

Each view is one SQL text that Spark and DuckDB both run, so queries and their reference SQL start from the
same rows. A view scans one table; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHOICE = """
SELECT o_orderkey AS question_id, 'img_' || cast(o_orderkey % 50 AS varchar(20)) || '.pt' AS image, 'Which finding fits?' AS question,
  CASE o_custkey % 6 WHEN 0 THEN 'Answer: C, F.' WHEN 1 THEN 'A' WHEN 2 THEN 'The answer is B' WHEN 3 THEN 'A, C'
       WHEN 4 THEN 'none' ELSE o_orderstatus || ': D or so' END AS prediction,
  CASE WHEN o_orderkey % 11 = 0 THEN 'AB' WHEN o_orderkey % 3 = 0 THEN 'A, C' WHEN o_orderkey % 5 = 0 THEN 'none'
       ELSE chr(cast(65 + o_orderkey % 6 AS int)) END AS ground_truth,
  CASE WHEN o_orderkey % 3 = 0 THEN 'multi' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'single' END AS format,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(1 + o_orderkey % 2 AS varchar(20)) || '.' || cast(1 + o_orderkey % 4 AS varchar(20)) END AS subcategory,
  CASE o_orderkey % 4 WHEN 0 THEN 'WSI' WHEN 1 THEN 'Cluster' WHEN 2 THEN 'ROI' END AS belong_level,
  CASE o_orderkey % 5 WHEN 0 THEN 'architecture' WHEN 1 THEN 'stroma' WHEN 2 THEN 'cytology' WHEN 3 THEN 'diagnosis' END AS focus
FROM {orders}
"""

OPEN = """
SELECT * FROM (
  SELECT conv_id * 100 + turn AS question_id, 'img_' || cast(conv_id AS varchar(20)) || '.pt' AS image,
    'q' AS question, text AS ground_truth, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction, 'open' AS format,
    cast(1 + conv_id % 2 AS varchar(20)) || '.' || cast(1 + conv_id % 4 AS varchar(20)) AS subcategory,
    CASE conv_id % 3 WHEN 0 THEN 'WSI' WHEN 1 THEN 'Cluster' ELSE 'ROI' END AS belong_level,
    CASE conv_id % 4 WHEN 0 THEN 'architecture' WHEN 1 THEN 'stroma' WHEN 2 THEN 'cytology' END AS focus
  FROM {conversations}) t WHERE prediction IS NOT NULL
"""

#: By p_partkey % 8: object, array of texts, keys with descriptions, labelled objects, one text, choices, null, colons.
RAW_QA = """
SELECT p_partkey, 'session_' || cast(p_partkey % 20 AS varchar(20)) AS session, '{{"qa_id":"q' || cast(p_partkey AS varchar(20)) || '","image_path":"feat/' || cast(p_partkey % 37 AS varchar(20)) || '.pt","question":"' ||
  CASE WHEN p_partkey % 29 = 0 THEN '  ' ELSE 'What about ' || p_name || '?' END || '","format":"' || CASE p_partkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' ELSE 'open' END || '",' ||
  CASE p_partkey % 8 WHEN 0 THEN '"options":{{"B":"' || p_name || '","A":"' || p_type || '"}}'
    WHEN 1 THEN '"options":["A. ' || p_name || '","B. ' || p_type || '"]'
    WHEN 2 THEN '"options":["A","B","C"],"option_descriptions":{{"A":"' || p_name || '","C":"' || p_type || '"}}'
    WHEN 3 THEN '"options":[{{"key":"A","label":"' || p_name || '"}},{{"key":"B","label":"' || p_type || '"}}]'
    WHEN 4 THEN '"options":"A: ' || p_name || ', B ' || p_type || '"'
    WHEN 5 THEN '"options":["x"],"choices":{{"A":"' || p_name || '","B":"' || p_type || '"}}'
    WHEN 6 THEN '"options":null' ELSE '"options":["A: ok"]' END || ',' ||
  CASE p_partkey % 5 WHEN 0 THEN '"answer_index":[0,1]' WHEN 1 THEN '"answer_idx":2,"answer":"A"' WHEN 2 THEN '"answer_key":"","answer":"C"'
    WHEN 3 THEN '"answer_keys":["A","D"]' ELSE '"answer":"' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'B' END || '"' END ||
  ',"subcategory":"1.' || cast(1 + p_partkey % 4 AS varchar(20)) || '","belong_level":"' || CASE p_partkey % 3 WHEN 0 THEN 'WSI' WHEN 1 THEN 'Cluster' ELSE 'ROI' END || '"}}' AS value
FROM {part}
"""

PATCHES = """
SELECT 'slide_' || cast(label AS varchar(20)) || '_' || cast(block AS varchar(20)) AS slide_id, cast(i AS int) AS patch_idx, cast(512 * (i % 8) AS double) AS x,
  cast(512 * floor(i / 8) AS double) AS y, embedding AS feature
FROM (SELECT label, embedding, block, row_number() OVER (PARTITION BY label, block ORDER BY vec_id) - 1 AS i
  FROM (SELECT label, embedding, vec_id, cast(floor(vec_id / 1000) AS bigint) AS block FROM {embeddings}) b) t
"""

TOKENS = """
SELECT 'slide_' || cast(label AS varchar(20)) AS slide_id, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS token_idx, embedding
FROM {embeddings}
"""

GEOMETRY = """
SELECT 'slide_' || cast(cast(floor(p_partkey / 3) AS bigint) AS varchar(20)) AS slide_id, 'cluster_' || cast(p_partkey % 3 AS varchar(20)) AS cluster_id,
  p_retailprice * 2.5 AS center_x, p_retailprice * 1.25 + p_size AS center_y,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_size * 12.5 END AS radius, cast(p_size * 5 AS int) AS count, p_partkey AS position
FROM {part}
"""

SLIDES = """
SELECT 'slide_' || cast(s_suppkey AS varchar(20)) AS slide_id, cast(2000 + s_suppkey * 37 % 5000 AS bigint) AS width, cast(1500 + s_suppkey * 53 % 4000 AS bigint) AS height
FROM {supplier}
"""

CASES = """
SELECT s_suppkey AS position, CASE WHEN s_suppkey % 4 = 3 THEN 'other_' ELSE 'slide_' END || cast(s_suppkey AS varchar(20)) || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '.svs' END AS img,
  s_name || ', IHC: CK' || cast(s_nationkey AS varchar(20)) || '(+), Ki67. pT' || cast(s_suppkey % 5 AS varchar(20)) || 'N' || cast(s_suppkey % 3 AS varchar(20)) || ' end' AS diagnosis
FROM {supplier}
"""

LABELS = """
SELECT cast(d.doc_id AS varchar(20)) AS id, l.quality AS quality, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE l.toxic END AS toxic, d.lang AS lang
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

LLM_TEXT = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json ' || props || ' ```' WHEN 2 THEN 'Sure: ' || props || ' done'
  WHEN 3 THEN 'nothing here' WHEN 4 THEN 'list [' || props || ',' || props || '] end' ELSE '' END AS text, props
FROM {events}
"""

STATUS = """
SELECT 'slide_' || cast(user_id AS varchar(20)) AS slide_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'skipped' ELSE 'pending' END AS status
FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) t WHERE r = 1
"""

_TABLES = ("orders", "conversations", "part", "embeddings", "supplier", "documents", "labels", "events", "customer", "lineitem", "nation")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view's rows in Spark."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def inline(text: str) -> str:
    """The view as a parenthesised subquery over the tables' names, for DuckDB."""
    return "(" + text.format(**{t: t for t in _TABLES}) + ")"
