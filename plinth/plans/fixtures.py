"""Relations of the data model derived from the star-schema tables.

Each is one SQL text that both engines understand, so a query and its oracle start from the
same rows.  ``{name}`` stands for a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import scratch

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages"]

_KEYED = """
SELECT 'Geo.Region' AS module, 'R' || r_regionkey AS name, CAST(r_regionkey AS BIGINT) AS k FROM {region}
UNION ALL SELECT 'Geo.Nation', 'N' || n_nationkey, CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'Party.Supplier', 'S' || s_suppkey, s_suppkey FROM {supplier}
UNION ALL SELECT 'Party.Customer', 'C' || c_custkey, c_custkey FROM {customer}
UNION ALL SELECT 'Item.Part', 'P' || p_partkey, p_partkey FROM {part}
UNION ALL SELECT 'Sales.Order', 'O' || o_orderkey, o_orderkey FROM {orders}
"""
NODES = f"""
SELECT 'lean:' || module || '.' || name AS id, module || '.' || name AS full_name, name, 'thm' AS kind, module,
  replace(module, '.', '/') || '.lean' AS source_path, CAST(k * 2 + 1 AS INT) AS source_start_line, CAST(k * 2 + 2 AS INT) AS source_end_line, 'r1' AS source_revision
FROM ({_KEYED}) g
"""
#: Most nodes have a chunk, some have none, some have a second one of the same name.
CHUNKS = f"""
SELECT 'src:' || replace(module, '.', '/') || '.lean:' || a || ':' || (a + 1) AS id, 'r1' AS source_revision, replace(module, '.', '/') || '.lean' AS source_path,
  CAST(a AS INT) AS source_start_line, CAST(a + 1 AS INT) AS source_end_line, name AS declaration_hint, repeat(name || ' ', CAST(20 + k % 7 AS INT)) AS text
FROM (SELECT module, name, k, k * 2 + 1 AS a FROM ({_KEYED}) g WHERE k % 5 <> 0 UNION ALL SELECT module, name, k, k * 2 + 20000001 FROM ({_KEYED}) h WHERE k % 7 = 0) c
"""
_PAIRS = """
SELECT 'Geo.Nation.N' || n_nationkey AS s, 'Geo.Region.R' || n_regionkey AS t, 'type' AS kind FROM {nation}
UNION ALL SELECT 'Party.Supplier.S' || s_suppkey, 'Geo.Nation.N' || s_nationkey, 'type' FROM {supplier}
UNION ALL SELECT 'Party.Customer.C' || c_custkey, 'Geo.Nation.N' || c_nationkey, 'type' FROM {customer}
UNION ALL SELECT 'Sales.Order.O' || o_orderkey, 'Party.Customer.C' || o_custkey, 'value' FROM {orders}
UNION ALL SELECT DISTINCT 'Sales.Order.O' || l_orderkey, 'Item.Part.P' || l_partkey, 'value' FROM {lineitem}
UNION ALL SELECT DISTINCT 'Item.Part.P' || l_partkey, 'Party.Supplier.S' || l_suppkey, 'value' FROM {lineitem}
UNION ALL SELECT 'Geo.Region.R' || n_regionkey, 'Geo.Nation.N' || min(n_nationkey), 'value' FROM {nation} GROUP BY n_regionkey
"""
EDGES = f"""
SELECT 'lean:' || s AS source_id, 'lean:' || t AS target_id, kind || '_dependency' AS relation,
  CASE kind WHEN 'type' THEN 'ELABORATED_TYPE_DEPENDENCY' ELSE 'ELABORATED_VALUE_DEPENDENCY' END AS evidence_grade, 'star' AS producer
FROM ({_PAIRS}) e
"""
#: The extractor's form: also nodes out of scope, some with short names that others have.
RAW_NODES = f"""
SELECT name, module, kind, full_name AS fullName FROM ({NODES}) n
UNION ALL SELECT 'N' || n_nationkey, 'Ext.Nation', 'thm', 'Ext.Nation.Sub.N' || n_nationkey FROM {{nation}} WHERE n_nationkey < 5
UNION ALL SELECT 'X' || n_nationkey, 'Extra', 'thm', 'Extra.X' || n_nationkey FROM {{nation}}
"""
#: Dependency first, each even edge twice, short names for some ends.
RAW_EDGES = f"""
SELECT CASE WHEN t LIKE 'Geo.Nation.%' THEN substr(t, 12) ELSE t END AS source, s AS target, kind FROM ({_PAIRS}) e
UNION ALL SELECT t, s, kind FROM ({_PAIRS}) f WHERE t LIKE '%2'
UNION ALL SELECT 'Geo.Region.R0', 'Extra.X' || n_nationkey, 'type' FROM {{nation}}
"""
#: The edges' pairs as Spark makes them: repeated pairs are told by their keys, which are a fraction
#: of the names, and the raw edges by one pass over the pairs.
_KEYED_PAIRS = _PAIRS
for _a, _b in (("'Sales.Order.O' || l_orderkey", "'Item.Part.P' || l_partkey"), ("'Item.Part.P' || l_partkey", "'Party.Supplier.S' || l_suppkey")):
    _keys = ", ".join(x.split("|| ")[1] for x in (_a, _b))
    _KEYED_PAIRS = _KEYED_PAIRS.replace(f"SELECT DISTINCT {_a}, {_b}, 'value' FROM {{lineitem}}", f"SELECT {_a}, {_b}, 'value' FROM (SELECT DISTINCT {_keys} FROM {{lineitem}})")
_MADE = {
    EDGES: EDGES.replace(_PAIRS, _KEYED_PAIRS),
    RAW_EDGES: f"""
SELECT inline(CASE WHEN t LIKE '%2' THEN array(struct(short AS source, s AS target, kind), struct(t AS source, s AS target, kind)) ELSE array(struct(short AS source, s AS target, kind)) END)
FROM (SELECT s, t, kind, CASE WHEN t LIKE 'Geo.Nation.%' THEN substr(t, 12) ELSE t END AS short FROM ({_KEYED_PAIRS}) e) f
UNION ALL SELECT 'Geo.Region.R0', 'Extra.X' || n_nationkey, 'type' FROM {{nation}}
""",
}
CORPORA = """
SELECT 'doc-' || doc_id AS id, 'r1' AS source_revision, source AS source_id, source || '/' || doc_id AS source_path, 1 AS source_start_line, 1 AS source_end_line, lang || ' ' || source AS declaration_hint, text FROM {documents}
"""
GENERATION_DOCS = """
SELECT lang AS generation_id, source AS source_id, source || '::' || doc_id AS candidate_id, CAST(NULL AS STRING) AS declaration_id, 'doc-' || doc_id AS source_row_id,
  source || '/' || doc_id AS source_path, 1 AS source_line, CASE WHEN doc_id % 3 = 0 THEN 'D' || doc_id END AS exact_identity, text AS body_text FROM {documents}
"""


#: One declaration per document; in two corpora one is named like a word that texts have, in a
#: third two are.
DECLARATIONS = """
SELECT source AS source_id, 'lean:' || source || '.' || name AS id, source || '.' || name AS full_name, name, 'thm' AS kind, source AS module, source || '/' || doc_id AS source_path, 1 AS source_start_line, 1 AS source_end_line, 'r1' AS source_revision
FROM (SELECT source, doc_id, CASE WHEN place = 1 AND source IN ('src1', 'src2', 'src4') OR place = 2 AND source = 'src4' THEN CASE WHEN place = 2 THEN 'Sub.heon' ELSE 'heon' END ELSE 'D' || doc_id END AS name
  FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM {documents}) p) q
"""
#: Members of structures, which only their parent's chunk declares.
BOUND_CHUNKS = f"""
SELECT 'src:' || replace(module, '.', '/') || '.lean:' || (k * 2 + 1) || ':' || (k * 2 + 2) AS id, 'r1' AS source_revision, replace(module, '.', '/') || '.lean' AS source_path,
  CAST(k * 2 + 1 AS INT) AS source_start_line, CAST(k * 2 + 2 AS INT) AS source_end_line, name AS declaration_hint, 'structure ' || name || chr(10) || CASE WHEN k % 3 = 0 THEN '  field : x' ELSE 'x field' END AS text
FROM ({_KEYED}) g WHERE k % 5 <> 0
"""
BOUND_NODES = f"""
SELECT id, full_name, name, kind, module, source_revision FROM ({NODES}) n
UNION ALL SELECT id || '.field', full_name || '.field', 'field', kind, module, source_revision FROM ({NODES}) m
"""

#: Relations that queries read as stored tables, as a query of the engine reads an artifact.
STORED = {NODES, EDGES, CHUNKS, RAW_NODES, RAW_EDGES, CORPORA, GENERATION_DOCS, DECLARATIONS, BOUND_CHUNKS, BOUND_NODES}
_made: dict[tuple[str, ...], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the tables below a folder."""
    target, fs = scratch.hadoop(spark, sf_dir)
    return "|".join(sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(target)))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The folder of something that is made once per session and tables; made anew if the
    folder is gone or a table's files have changed."""
    key = spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir)
    path = _made.get(key)
    if path is not None:
        target, fs = scratch.hadoop(spark, path)
        if fs.exists(target):
            return path
    path = scratch.new_path(spark, "fixture")
    make(path)
    _made[key] = path
    return path


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation as a DataFrame; tables are bound by name, without any global view."""

    def made() -> DataFrame:
        text = _MADE.get(sql, sql)
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})

    if sql not in STORED:
        return made()
    return spark.read.parquet(kept(spark, sf_dir, sql, lambda path: made().write.parquet(path)))


def oracle(sql: str) -> str:
    """The relation as a SQL sub-select over views of the tables' names."""
    return "(" + sql.format(**{t: t for t in TABLES}) + ")"
