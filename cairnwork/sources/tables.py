"""Tables of a folder, and the domain tables that are bound to them.

A binding is one SELECT in the SQL that Spark and DuckDB share; names in braces are tables or other bindings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BINDINGS: dict[str, str] = {
    # A store's tiles: payloads with exact copies among them.
    "tiles": """SELECT 'd' || CAST(doc_id AS STRING) AS key, text AS payload FROM {documents}
        UNION ALL SELECT 'p' || CAST(page_id AS STRING) AS key, html AS payload FROM {pages}""",
    "cells": """SELECT p_partkey AS cell_id, p_name AS name, CAST(p_partkey % 128 AS INT) AS type_code, CAST(1 + p_partkey % 13 AS INT) AS dtype_code,
        CAST(p_size AS BIGINT) AS dim, CAST(p_size * 4096 AS BIGINT) AS size, CAST(p_size * 1024 AS BIGINT) AS stored_size,
        CAST(p_partkey % 3 AS INT) AS major, CAST(p_partkey % 5 AS INT) AS minor,
        CASE WHEN p_partkey % 11 = 0 THEN 'Deprecated' WHEN p_partkey % 17 = 0 THEN 'Tombstone' ELSE 'Active' END AS lifecycle FROM {part}""",
    # A graph without cycles: every cell needs those of half and of a third of its number.
    "deps": """SELECT p_partkey AS source, CAST(FLOOR(p_partkey / 2e0) AS BIGINT) AS target, CAST(p_partkey % 5 AS INT) AS kind FROM {part} WHERE p_partkey >= 2
        UNION ALL SELECT p_partkey AS source, CAST(FLOOR(p_partkey / 3e0) AS BIGINT) AS target, CAST((p_partkey + 2) % 5 AS INT) AS kind FROM {part} WHERE p_partkey >= 3""",
    "memory": """SELECT d.doc_id AS id, CAST(1 + d.doc_id % 5 AS INT) AS memory_type, d.source AS key, d.text AS value, d.lang AS lang,
        1e-1 + 4e-1 * COALESCE(l.quality, 0) + 5e-2 * (d.doc_id % 10) AS importance, d.doc_id % 120 AS access_count,
        1e0 * (d.doc_id % 720) AS age_hours, CASE WHEN d.doc_id % 7 = 0 THEN 'Archived' ELSE 'Active' END AS lifecycle, e.embedding AS embedding
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id""",
    "access_log": """SELECT event_id AS seq, user_id AS cell, event_type, value, ts, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success FROM {events}""",
    "sequences": """SELECT CAST(user_id AS STRING) || '|' || SUBSTRING(CAST(ts AS STRING), 1, 10) AS seq_id, event_id AS pos, event_type AS cell FROM {events}""",
    "routing": """SELECT p_partkey AS hash, LOWER(p_type) AS cell_type, CAST(p_size * 1000 AS BIGINT) AS size, p_partkey % 2 = 0 AS is_local,
        CAST(FLOOR(p_retailprice) AS BIGINT) AS latency_us, (p_partkey * 7) % 1000 AS access_count, p_partkey % 20 AS selections, (p_partkey % 20) * (p_partkey % 3) / 2e0 AS successes,
        1e0 * (p_partkey % 48) AS age_hours FROM {part}""",
    "revisions": """SELECT o_orderkey AS rev, o_custkey AS branch, o_orderdate AS ts, o_orderpriority AS priority,
        LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM {orders}""",
    # A graph of revisions with merges: besides the one before it in its branch every fourth revision has another of its group as parent.
    "dag": """SELECT o_orderkey AS rev, o_orderdate AS ts, o_orderstatus AS status, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM {orders}
        UNION ALL SELECT rev, ts, status, parent FROM (SELECT o_orderkey AS rev, o_orderdate AS ts, o_orderstatus AS status, LAG(o_orderkey) OVER (PARTITION BY CAST(FLOOR(o_custkey / 8e0) AS BIGINT) ORDER BY o_orderdate, o_orderkey) AS parent FROM {orders}) m WHERE rev % 4 = 0 AND parent IS NOT NULL""",
    # Asked pairs: a revision and another of its group in an order that has nothing to do with time.
    "dag_pairs": """SELECT a, b FROM (SELECT o_orderkey AS a, LAG(o_orderkey) OVER (PARTITION BY CAST(FLOOR(o_custkey / 8e0) AS BIGINT) ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS b FROM {orders}) p WHERE b IS NOT NULL AND a % 5 = 0""",
    # Merges: every revision with the one before it of its group in that order; only the first of a group has none.
    "dag_merges": """SELECT a, b FROM (SELECT o_orderkey AS a, LAG(o_orderkey) OVER (PARTITION BY CAST(FLOOR(o_custkey / 8e0) AS BIGINT) ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS b FROM {orders}) p WHERE b IS NOT NULL""",
    # One log of updates of all nine kinds.
    "updates": """SELECT event_id AS seq, CAST(event_id % 9 AS INT) AS kind, user_id % 25 AS pattern, 1 + event_id % 7 AS frequency, COALESCE(value, 0e0) AS compute,
        CASE WHEN event_type <> 'error' THEN 8e-1 ELSE 2e-1 END AS confidence, user_id AS cell, CASE WHEN event_id % 2 = 0 THEN user_id + 1000 END AS other FROM {events}""",
    "rev_cells": "SELECT l_orderkey AS rev, l_partkey AS cell, l_suppkey AS tile, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS amount FROM {lineitem}",
    "wal": """SELECT event_id AS seq, user_id % 50 AS txn, CASE event_type WHEN 'signup' THEN 'Begin' WHEN 'view' THEN 'Write' WHEN 'click' THEN 'Stage' WHEN 'purchase' THEN 'Commit' ELSE 'Rename' END AS record_type FROM {events}""",
}


class Tables:
    """Tables and bindings of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BINDINGS:
            return self.sql(BINDINGS[name])
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def oracle(text: str) -> str:
    """The SQL of a query, with the bindings that it names in braces in front."""
    needed: list[str] = []

    def need(part: str) -> None:
        for name in re.findall(r"\{(\w+)\}", part):
            if name in BINDINGS and name not in needed:
                need(BINDINGS[name])
                needed.append(name)

    need(text)
    bare = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    if not needed:
        return bare(text)
    front = ", ".join(f"{n} AS ({bare(BINDINGS[n])})" for n in needed)
    body = bare(text)
    recursive = body.lstrip().upper().startswith("WITH RECURSIVE")
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {'RECURSIVE ' * recursive}{front}, " + re.sub(r"^\s*WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
    return f"WITH {front} {body}"
