"""Named queries over the driver's tables and their plain-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..bridge import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RELATIONS = {
    "nodes": """
WITH n AS (
  SELECT l_suppkey, l_partkey, l_orderkey, l_quantity,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_shipdate) AS rn
  FROM lineitem),
b AS (
  SELECT concat('n', lpad(CAST(l_suppkey AS VARCHAR(12)), 5, '0'), '.swc') AS file_id,
         CAST(rn AS INT) AS node_id,
         CASE WHEN rn = 1 THEN 1 WHEN l_suppkey % 5 = 0 THEN 2 ELSE CAST(2 + l_partkey % 3 AS INT) END AS type,
         CAST(l_partkey * 7 % 400 AS DOUBLE) + 0.5 AS x, l_quantity * 5 - 2.5 AS y,
         CAST(l_orderkey % 300 AS DOUBLE) + 0.25 AS z, CAST(1.0 AS DOUBLE) AS radius,
         CASE WHEN rn = 1 THEN -1 ELSE CAST(floor(rn / 2.0) AS INT) END AS parent_id,
         CAST(l_suppkey % 7 AS VARCHAR(12)) AS subject, CAST(l_suppkey % 9 AS VARCHAR(12)) AS neuron_id,
         l_partkey % 17 <> 0 AS flatmap_shaped_valid, l_orderkey % 11 AS dk
  FROM n)
SELECT file_id, node_id, type, x, y, z, radius, parent_id, subject, neuron_id,
       CASE WHEN floor(x / 25) = 15 AND floor(y / 25) = 9 THEN 0
            ELSE CAST(10 * (1 + floor(x / 100)) + 1 + floor(y / 125) AS INT) END AS region_id,
       x * 0.01 AS x_flat_shaped, y * 0.01 AS y_flat_shaped, flatmap_shaped_valid,
       CASE WHEN dk = 0 THEN -1.0 ELSE z * 3 END AS depth_um, dk <> 0 AS depth_valid
FROM b""",
    "annotation": """
SELECT a.ai, b.bi, c.ci,
       CASE WHEN a.ai = 15 AND b.bi = 9 THEN 0
            ELSE CAST(10 * (1 + floor(a.ai / 4.0)) + 1 + floor(b.bi / 5.0) AS INT) END AS region_id
FROM (SELECT DISTINCT CAST(l_partkey % 16 AS INT) AS ai FROM lineitem) a
CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 10 AS INT) AS bi FROM lineitem) b
CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 12 AS INT) AS ci FROM lineitem) c""",
    "lookup": """
SELECT ai, bi, ci,
       CAST(CASE WHEN (ai + bi + ci) % 13 = 0 THEN -1.0 ELSE ai * 0.25 END AS DOUBLE) AS x_flat,
       CAST(CASE WHEN (ai + bi + ci) % 13 = 0 THEN -1.0 ELSE bi * 0.25 END AS DOUBLE) AS y_flat,
       CAST(CASE WHEN ci % 5 = 0 THEN -1.0 ELSE ci * 75.0 END AS DOUBLE) AS depth_um
FROM annotation""",
    "structures": """
SELECT * FROM (VALUES
  (1, 'root', 'root', '/1/'), (5, 'Isocortex', 'Isocortex', '/1/5/'),
  (10, 'A', 'Area A', '/1/5/10/'), (20, 'B', 'Area B', '/1/5/20/'), (30, 'C', 'Area C', '/1/5/30/'),
  (40, 'CP', 'Caudoputamen', '/1/40/'),
  (11, 'A1', 'Area A, layer 1', '/1/5/10/11/'), (12, 'A2/3', 'Area A, layer 2/3', '/1/5/10/12/'),
  (21, 'B4', 'Area B, layer 4', '/1/5/20/21/'), (22, 'B5', 'Area B, layer 5', '/1/5/20/22/'),
  (31, 'C6a', 'Area C, layer 6a', '/1/5/30/31/'), (32, 'C6b', 'Area C, layer 6b', '/1/5/30/32/'),
  (41, 'CPa', 'Caudoputamen a', '/1/40/41/'), (42, 'CPb', 'Caudoputamen b', '/1/40/42/')
) AS t(id, acronym, name, structure_id_path)""",
    "named": """
SELECT nodes.*, s.acronym AS region_acronym, s.name AS region_name
FROM nodes LEFT JOIN structures s ON s.id = nodes.region_id""",
    "closure": """
SELECT CAST(ids[p] AS INT) AS ancestor_region_id, id AS direct_region_id, CAST(len(ids) - p AS INT) AS depth
FROM (SELECT id, string_split(trim(structure_id_path, '/'), '/') AS ids FROM structures) s,
     generate_series(1, 9) g(p) WHERE p <= len(ids)""",
    "mask": "SELECT ai, bi, ci FROM annotation WHERE ai BETWEEN 4 AND 9 AND bi BETWEEN 2 AND 6 AND ci BETWEEN 3 AND 8",
    "points": """
SELECT event_type AS label, CAST(event_id * 7 % 300 AS DOUBLE) + 0.5 AS x, CAST(user_id % 250 AS DOUBLE) AS y,
       CAST(event_id % 400 AS DOUBLE) AS z, CAST(NULL AS VARCHAR(20)) AS region_name, CAST(NULL AS VARCHAR(20)) AS acronym,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 11 END AS id,
       CASE WHEN event_id % 4 = 0 THEN 'left' ELSE NULL END AS hemisphere,
       CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('f', CAST(user_id % 5 AS VARCHAR(4)), '.csv') END AS origin_csv
FROM events""",
    "annotations": """
SELECT concat('n', lpad(CAST(s_suppkey AS VARCHAR(12)), 5, '0'), '.swc') AS file_id, CAST(s_nationkey AS VARCHAR(12)) AS label,
       CASE s_suppkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["a"]' WHEN 2 THEN '["a","b"]' ELSE '["b"]' END AS tags
FROM supplier""",
    "assignments": """
SELECT 'A' AS assignment_id, concat('n', lpad(CAST(s_suppkey AS VARCHAR(12)), 5, '0'), '.swc') AS file_id,
       CAST(1 + s_suppkey % 3 AS INT) AS label FROM supplier
UNION ALL
SELECT 'B', concat('n', lpad(CAST(s_suppkey AS VARCHAR(12)), 5, '0'), '.swc'), CAST(1 + s_suppkey % 4 AS INT)
FROM supplier WHERE s_suppkey % 7 <> 0""",
}
NEEDS = {"lookup": ["annotation"], "mask": ["annotation"], "named": ["nodes", "structures"], "closure": ["structures"]}


def relation(name: str, sql: str, *needs: str) -> None:
    RELATIONS[name], NEEDS[name] = sql, list(needs)


def with_relations(names: str, body: str) -> str:
    """Prefix a SELECT with the relations it reads, each after the ones it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({RELATIONS[name]})" for name in ordered)
    if not ctes:
        return body
    rest = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if rest.startswith(head):
            return f"{head}{ctes},\n{rest[len(head):]}"
    return f"WITH {ctes}\n{rest}"


def query(name: str, reads: str = "", sql: str | None = None):
    """Register a query; ``reads`` lists the relations of its SQL twin."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_relations(reads, sql)
        return build

    return wrap
