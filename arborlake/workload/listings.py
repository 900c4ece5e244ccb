"""Scans, listings, summaries, filters and tree queries."""

from pyspark.sql import functions as F

from ..functions import natural_key, node_type_label, region_name_form
from ..operators import catalog as C, filters as X, topology as T
from ..sources import nodes as S
from ..workload.registry import query, relation

NODE_COLS = ("file_id, node_id, type, x, y, z, radius, parent_id, subject, neuron_id, region_id, "
             "x_flat_shaped, y_flat_shaped, flatmap_shaped_valid, depth_um, depth_valid")
FINITE = "isfinite(x) AND isfinite(y) AND isfinite(z)"
IDX = "CAST(floor(x / 25) AS BIGINT) AS ai, CAST(floor(y / 25) AS BIGINT) AS bi, CAST(floor(z / 25) AS BIGINT) AS ci"


@query("scan_nodes", "nodes", f"SELECT {NODE_COLS} FROM nodes")
def _(t):
    return t.nodes


@query("has_column", "nodes", "SELECT count(*) AS n, true AS has_type, false AS has_colour FROM nodes")
def _(t):
    return t.nodes.agg(
        F.count("*").alias("n"), F.lit(C.has_column(t.nodes, "type")).alias("has_type"),
        F.lit(C.has_column(t.nodes, "colour")).alias("has_colour"))


@query("sql_query", "nodes", """
SELECT file_id, count(*) AS n, sum(CASE WHEN type = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS axon FROM nodes
WHERE x >= 100.0 AND region_id <> 41 GROUP BY file_id""")
def _(t):
    return S.sql_query(
        t.nodes,
        "SELECT file_id, count(*) AS n, CAST(sum(CASE WHEN type = ? THEN 1.0D ELSE 0.0D END) AS DOUBLE) AS axon "
        "FROM neurons WHERE x >= ? AND region_id <> ? GROUP BY file_id", [2, 100.0, 41])


@query("neurons_by_region", "named", """
SELECT DISTINCT file_id, neuron_id, subject FROM named WHERE region_acronym IN ('A1', 'B5') AND type IN (3, 4)
AND file_id <> 'n00003.swc'""")
def _(t):
    return C.neurons_by_region(t.named_nodes, ["A1", "B5"], node_types=[3, 4], exclude_file_ids=["n00003.swc"])


@query("neurons_by_region_id", "nodes", """
SELECT DISTINCT file_id, neuron_id, subject FROM nodes WHERE region_id IN (31, 32, 42) AND type = 1""")
def _(t):
    return C.neurons_by_region_id(t.nodes, [31, 32, 42], soma_only=True)


@query("nodes_of", "nodes assignments", f"""
SELECT {NODE_COLS} FROM nodes WHERE file_id IN (SELECT file_id FROM assignments WHERE assignment_id = 'B')""")
def _(t):
    return C.nodes_of(t.nodes, t.assignments.filter("assignment_id = 'B'").select("file_id"))


@query("soma_nodes", "nodes", f"SELECT {NODE_COLS} FROM nodes WHERE type = 1")
def _(t):
    return C.soma_nodes(t.nodes)


@query("soma_points", "nodes", "SELECT file_id, neuron_id, x, y, z FROM nodes WHERE type = 1")
def _(t):
    return C.soma_points(t.nodes)


@query("scope_filter", "nodes assignments", f"""
SELECT {NODE_COLS} FROM nodes WHERE file_id NOT IN (SELECT file_id FROM assignments WHERE assignment_id = 'B')""")
def _(t):
    return X.scope_filter(t.nodes, t.assignments.filter("assignment_id = 'B'").select("file_id"), keep=False)


@query("ordered_results", "nodes", "SELECT file_id, node_id, type, region_id FROM nodes WHERE region_id = 11")
def _(t):
    return t.nodes.filter("region_id = 11").select("file_id", "node_id", "type", "region_id").orderBy("file_id", "node_id")


@query("voxel_mask_filter", "nodes annotation mask", f"""
SELECT {NODE_COLS} FROM (SELECT *, {IDX} FROM nodes WHERE {FINITE}) n
WHERE EXISTS (SELECT 1 FROM annotation a WHERE a.region_id > 0 AND a.ai = n.ai AND a.bi = n.bi AND a.ci = n.ci)
AND NOT EXISTS (SELECT 1 FROM mask m WHERE m.ai = n.ai AND m.bi = n.bi AND m.ci = n.ci)""")
def _(t):
    return X.voxel_mask_filter(t.nodes, t.grid, t.annotation.filter("region_id > 0"), t.mask)


@query("soma_mask_filter", "nodes mask", f"""
SELECT file_id, x, y, z, soma_node_count FROM (
  SELECT *, {IDX} FROM (SELECT file_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS soma_node_count
                        FROM nodes WHERE type = 1 GROUP BY file_id) c) n
WHERE EXISTS (SELECT 1 FROM mask m WHERE m.ai = n.ai AND m.bi = n.bi AND m.ci = n.ci)""")
def _(t):
    return X.soma_mask_filter(C.soma_centroids(t.nodes), t.grid, t.mask)


@query("soma_exclusion_rules", "nodes mask annotation", f"""
WITH v AS (SELECT file_id, type, {IDX} FROM nodes WHERE {FINITE}),
a AS (SELECT file_id FROM v JOIN mask m USING (ai, bi, ci) WHERE type = 2 GROUP BY file_id HAVING count(*) >= 16),
b AS (SELECT file_id FROM v JOIN annotation r USING (ai, bi, ci) WHERE type IN (3, 4) AND r.region_id = 11
      GROUP BY file_id HAVING count(*) >= 40)
SELECT file_id FROM a UNION SELECT file_id FROM b""")
def _(t):
    return X.soma_exclusion_rules(t.nodes, t.grid, [
        X.ExclusionRule(t.mask, (2,), 16), X.ExclusionRule(t.annotation.filter("region_id = 11"), (3, 4), 40)])


@query("node_type_filter", "nodes", f"SELECT {NODE_COLS} FROM nodes WHERE type IS NULL OR type NOT IN (1, 3)")
def _(t):
    return X.node_type_filter(t.nodes, "exclude", [1, 3])


@query("require_dendrites", "nodes", f"""
SELECT {NODE_COLS} FROM nodes WHERE type = 2 AND file_id IN (SELECT file_id FROM nodes WHERE type IN (3, 4))""")
def _(t):
    return X.require_dendrites(t.nodes.filter("type = 2"), t.nodes)


def near(test, soma_where="type = 1"):
    return f"""
WITH s AS (SELECT file_id, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM nodes WHERE {soma_where} GROUP BY file_id)
SELECT {", ".join("n." + c.strip() for c in NODE_COLS.split(","))} FROM nodes n JOIN s USING (file_id) WHERE {test}"""


@query("exclude_near_soma", "nodes", near("pow(x - sx, 2) + pow(y - sy, 2) + pow(z - sz, 2) > 14400.0",
                                          "type = 1 AND " + FINITE))
def _(t):
    return X.exclude_near_soma(t.nodes, t.nodes, 120.0)


@query("within_soma_radius", "nodes", near("sqrt(pow(x - sx, 2) + pow(y - sy, 2) + pow(z - sz, 2)) <= 120.0"))
def _(t):
    return X.within_soma_radius(t.nodes, t.nodes, 120.0)


@query("annotation_filter", "annotations", """
SELECT file_id, label FROM annotations WHERE tags IN ('["a"]', '["a","b"]') AND label IN (SELECT label FROM annotations)""")
def _(t):
    rows = t.annotations.withColumn("tags", F.from_json("tags", "array<string>"))
    return X.annotation_filter(rows, X.AnnotationRule(tags=("a",), match="all")).select("file_id", "label")


@query("cluster_filter", "annotations assignments", """
SELECT n.file_id, a.label FROM annotations n LEFT JOIN assignments a ON a.file_id = n.file_id AND a.assignment_id = 'B'
WHERE a.label IS NULL OR a.label IN (2, 4)""")
def _(t):
    table = t.annotations.select("file_id").join(
        t.assignments.filter("assignment_id = 'B'").select("file_id", "label"), "file_id", "left")
    return X.cluster_filter(table, [2, 4], unclustered=True)


@query("slab_somas", "nodes", f"SELECT {NODE_COLS} FROM nodes WHERE type = 1 AND z BETWEEN 100 AND 200")
def _(t):
    return X.slab_somas(t.nodes, "z", 150.0, 50.0)


@query("project_plane", "nodes", """
WITH c AS (SELECT file_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nodes WHERE type = 1 GROUP BY file_id)
SELECT file_id, z AS horizontal, y AS vertical FROM c
WHERE abs(x - (SELECT median(x) FROM c)) <= 30.0""")
def _(t):
    return X.project_plane(C.soma_centroids(t.nodes), "coronal", slab=True, thickness=60.0)


# --- summaries

@query("unique_regions", "named", """
SELECT region_id, region_acronym, max(region_name) AS region_name, count(*) AS node_count FROM named
WHERE region_id > 0 GROUP BY region_id, region_acronym""")
def _(t):
    return C.unique_regions(t.named_nodes)


@query("region_neuron_counts", "named", """
SELECT region_acronym, max(region_name) AS region_name, count(DISTINCT file_id) AS neuron_count FROM named
WHERE region_acronym <> '' GROUP BY region_acronym""")
def _(t):
    return C.region_neuron_counts(t.named_nodes)


@query("neuron_catalog", "nodes", """
SELECT file_id, coalesce(min(neuron_id), '') AS neuron_id, coalesce(min(subject), '') AS subject FROM nodes GROUP BY file_id""")
def _(t):
    return C.neuron_catalog(t.nodes)


@query("soma_locations", "named", """
SELECT file_id, neuron_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(region_acronym) AS region_acronym
FROM named WHERE type = 1 GROUP BY file_id, neuron_id""")
def _(t):
    return C.soma_locations(t.named_nodes, [])


@query("soma_centroids", "nodes annotation", f"""
SELECT file_id, x, y, z, soma_node_count FROM (
  SELECT *, {IDX} FROM (SELECT file_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS soma_node_count
                        FROM nodes WHERE type = 1 GROUP BY file_id) c) n
WHERE EXISTS (SELECT 1 FROM annotation m WHERE m.region_id IN (11, 12, 21, 22, 31, 32) AND m.ai = n.ai AND m.bi = n.bi
              AND m.ci = n.ci)""")
def _(t):
    return C.soma_centroids(t.nodes, t.grid, t.annotation.filter("region_id IN (11, 12, 21, 22, 31, 32)"))


@query("statistics", "nodes", """
SELECT count(*) AS node_count, count(DISTINCT file_id) AS file_count, count(DISTINCT subject) AS subject_count,
count(DISTINCT CASE WHEN region_id > 0 THEN region_id END) AS region_count FROM nodes""")
def _(t):
    return C.statistics(t.nodes)


@query("parquet_summary", "named", """
SELECT 'total' AS section, 'rows' AS key, count(*) AS value FROM named
UNION ALL SELECT 'total', 'files', count(DISTINCT file_id) FROM named
UNION ALL SELECT 'total', 'subjects', count(DISTINCT subject) FROM named
UNION ALL SELECT 'region', region_acronym, count(*) FROM named WHERE region_acronym <> '' GROUP BY region_acronym""")
def _(t):
    return C.parquet_summary(t.named_nodes)


@query("node_types_present", "nodes", "SELECT DISTINCT type FROM nodes")
def _(t):
    return C.node_types_present(t.nodes)


@query("dendrite_coverage", "nodes", "SELECT file_id, bool_or(type IN (3, 4)) AS labelled FROM nodes GROUP BY file_id")
def _(t):
    return C.dendrite_coverage(t.nodes)


@query("soma_hemispheres", "nodes", """
WITH s AS (SELECT file_id, z AS c, CASE WHEN abs(z - 150.0) < 20.0 THEN 'midline' WHEN z < 150.0 THEN 'left' ELSE 'right' END AS side
           FROM nodes WHERE type = 1)
SELECT count(*) AS total_soma_nodes, count(DISTINCT file_id) AS neurons_with_soma,
count(*) FILTER (side = 'left') AS left_count, count(*) FILTER (side = 'midline') AS midline_count,
count(*) FILTER (side = 'right') AS right_count, min(c) AS coord_min, round(avg(c), 6) AS coord_mean, max(c) AS coord_max FROM s""")
def _(t):
    return C.soma_hemispheres(t.nodes, "z", 150.0, 20.0).withColumn("coord_mean", F.round("coord_mean", 6))


@query("natural_label_sort", "annotations", """
SELECT label, count(*) AS n, CAST(label AS VARCHAR) AS sort_body FROM annotations GROUP BY label""")
def _(t):
    counts = t.annotations.groupBy("label").agg(F.count("*").alias("n")).orderBy(natural_key("label"), "label")
    return counts.withColumn("sort_body", natural_key("label")[0]["body"])


@query("node_type_label", "nodes", """
SELECT type, CASE type WHEN 1 THEN 'Soma' WHEN 2 THEN 'Axon' WHEN 3 THEN 'Basal dendrite' WHEN 4 THEN 'Apical dendrite' END AS label,
count(*) AS n FROM nodes GROUP BY type""")
def _(t):
    return t.nodes.groupBy("type", node_type_label("type").alias("label")).agg(F.count("*").alias("n"))


@query("region_name_form", "structures nodes", """
SELECT s.id, trim(regexp_replace(regexp_replace(lower(name), '/', ', ', 'g'), '\\s+', ' ', 'g'), ' ,') AS form, count(*) AS n
FROM structures s JOIN nodes ON region_id = id GROUP BY s.id, name""")
def _(t):
    return t.named_nodes.filter("region_name IS NOT NULL").groupBy(
        F.col("region_id").alias("id"), region_name_form("region_name").alias("form")).agg(F.count("*").alias("n"))


# --- trees

EDGES = """
WITH e AS (SELECT c.file_id, c.node_id, c.parent_id, c.type, c.x AS x1, c.y AS y1, c.z AS z1, p.x AS x2, p.y AS y2, p.z AS z2
           FROM nodes c JOIN nodes p ON c.file_id = p.file_id AND c.parent_id = p.node_id)
"""


@query("edges", "nodes", EDGES + "SELECT * FROM e")
def _(t):
    return T.edges(t.nodes)


TERMINI = "NOT EXISTS (SELECT 1 FROM nodes c WHERE c.file_id = n.file_id AND c.parent_id = n.node_id)"


@query("termini", "nodes", f"SELECT {NODE_COLS} FROM nodes n WHERE type = 2 AND {TERMINI}")
def _(t):
    return T.termini(t.nodes)


@query("termini_coverage", "nodes", f"""
SELECT file_id, count(*) FILTER (type = 2) AS termini, count(*) FILTER (type <> 2) AS other_childless
FROM nodes n WHERE {TERMINI} GROUP BY file_id""")
def _(t):
    return T.termini_coverage(t.nodes)


@query("slab_segments", "nodes", EDGES + """
SELECT file_id, node_id, parent_id, type, x1, y1, 150.0::DOUBLE AS z1, x2, y2, 150.0::DOUBLE AS z2 FROM e
WHERE greatest(z1, z2) >= 140.0 AND least(z1, z2) <= 160.0""")
def _(t):
    return T.slab_segments(T.edges(t.nodes), "z", 150.0, 10.0)


# every rule broken once in some of the files: which one follows from the file's number
relation("damaged", """
WITH k AS (SELECT *, CAST(substr(file_id, 2, 5) AS INT) % 9 AS k FROM nodes)
SELECT file_id, node_id, CASE WHEN k = 2 AND node_id = 4 THEN NULL WHEN k = 7 AND node_id = 1 THEN 2 WHEN k = 7 AND node_id = 2 THEN 1 ELSE type END AS type,
  CASE WHEN k = 1 AND node_id = 3 THEN 'nan'::DOUBLE ELSE x END AS x, y, z,
  CASE WHEN k = 4 AND node_id = 6 THEN -1 WHEN k = 5 AND node_id = 2 THEN 4 WHEN k = 8 AND node_id = 8 THEN 1000000 ELSE parent_id END AS parent_id,
  CASE WHEN k = 3 AND node_id = 5 THEN -7 ELSE region_id END AS region_id
FROM k, range(2) c(copy) WHERE copy = 0 OR (k = 6 AND node_id = 7)""", "nodes")


@query("validate_trees", "damaged structures", """
WITH RECURSIVE reach AS (SELECT file_id, node_id FROM damaged WHERE parent_id = -1 UNION
  SELECT d.file_id, d.node_id FROM reach r JOIN damaged d ON d.file_id = r.file_id AND d.parent_id = r.node_id),
f AS (SELECT file_id, count(*) AS n, count(DISTINCT node_id) AS ids, count(*) FILTER (type IS NULL) AS blank, count(*) FILTER (isnan(x)) AS odd,
  count(*) FILTER (region_id < 0) AS negative, count(*) FILTER (parent_id = -1) AS roots, count(*) FILTER (type = 1) AS somas,
  count(*) FILTER (type = 1 AND parent_id <> -1) AS low FROM damaged GROUP BY file_id)
SELECT * FROM (
SELECT file_id, 'duplicate node_id' AS issue, n - ids AS n FROM f UNION ALL SELECT file_id, 'null value', blank FROM f
UNION ALL SELECT file_id, 'coordinate not finite', odd FROM f UNION ALL SELECT file_id, 'negative region_id', negative FROM f
UNION ALL SELECT file_id, 'not exactly one root', greatest(roots, 1) FROM f WHERE roots <> 1
UNION ALL SELECT file_id, 'not exactly one soma', greatest(somas, 1) FROM f WHERE somas <> 1
UNION ALL SELECT file_id, 'soma is not the root', low FROM f WHERE somas = 1
UNION ALL SELECT file_id, 'unknown region_id', count(*) FROM damaged WHERE region_id <> 0 AND region_id NOT IN (SELECT id FROM structures WHERE id <> 42) GROUP BY file_id
UNION ALL SELECT file_id, 'dangling parent_id', count(*) FROM damaged n WHERE parent_id <> -1 AND NOT EXISTS
  (SELECT 1 FROM damaged p WHERE p.file_id = n.file_id AND p.node_id = n.parent_id) GROUP BY file_id
UNION ALL SELECT file_id, 'not connected to the root', ids - (SELECT count(*) FROM reach r WHERE r.file_id = f.file_id) FROM f) q WHERE n > 0""")
def _(t):
    # an ontology without region 42, so that unknown regions come up as well
    k, node = F.substring("file_id", 2, 5).cast("int") % 9, F.col("node_id")
    rows = t.nodes.withColumns({
        "type": F.when((k == 2) & (node == 4), F.lit(None)).when((k == 7) & (node == 1), 2).when((k == 7) & (node == 2), 1).otherwise(F.col("type")),
        "x": F.when((k == 1) & (node == 3), float("nan")).otherwise(F.col("x")),
        "parent_id": F.when((k == 4) & (node == 6), -1).when((k == 5) & (node == 2), 4).when((k == 8) & (node == 8), 1_000_000).otherwise(F.col("parent_id")),
        "region_id": F.when((k == 3) & (node == 5), -7).otherwise(F.col("region_id")),
    })
    twice = rows.unionByName(rows.filter((k == 6) & (node == 7)))
    return T.validate_trees(twice, t.structures.filter("id <> 42"))
