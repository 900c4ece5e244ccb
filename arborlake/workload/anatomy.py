"""Flatmap occupancy, regional profile, region queries, report and features."""

from pyspark.sql import functions as F

from ..operators import occupancy as O, profile as P, regions as R, topology as T
from ..operators.catalog import neuron_catalog
from ..operators.flatmap import FlatGrid
from ..plans import region_index as I, region_query as Q, report as G
from ..plans.region_query import AllOf, AnyOf, NeuriteIn, Not, Regions, SomaIn, Threshold
from ..session import scratch_path, settle
from ..workload.registry import query, relation
from ..workload.similarity import rounded
from ..workload.voxels import cortex

# --- occupancy on a grid of 5 x 8 bins and 3 depth bins

FLAT = FlatGrid("", (0.0, 3.75), (0.0, 2.25), (0.0, 825.0), y_bins=5, x_bins=8, depth_bin_um=300.0)
relation("occ", """
SELECT a.region_id, (greatest(0, least(2, CAST(floor(d / 300.0) AS BIGINT))) * 5
  + greatest(0, least(4, CAST(floor(l.y_flat / 2.25 * 5) AS BIGINT)))) * 8 + greatest(0, least(7, CAST(floor(l.x_flat / 3.75 * 8) AS BIGINT))) AS linear_bin,
count(*) AS n
FROM annotation a JOIN (SELECT l.*, CASE WHEN l.depth_um >= 0 THEN l.depth_um ELSE m.depth_um END AS d FROM lookup l
  LEFT JOIN lookup m ON m.ai = l.ai AND m.bi = l.bi AND m.ci = 11 - l.ci) l USING (ai, bi, ci)
WHERE a.region_id > 0 AND d >= 0 AND NOT (l.x_flat = -1 AND l.y_flat = -1) GROUP BY 1, 2""", "annotation", "lookup")
relation("flat_occ", "SELECT region_id, linear_bin % 40 AS linear_bin, sum(n)::BIGINT AS n FROM occ GROUP BY 1, 2", "occ")
MAJORITY = """
SELECT linear_bin, first(region_id ORDER BY n DESC, region_id) AS region_id, max(n) AS n, count(*) > 1 AS collision FROM {0} GROUP BY linear_bin"""


def occ(t):
    return O.occupancy(t.annotation, t.lookup, t.grid, FLAT)


@query("occupancy", "occ", "SELECT * FROM occ")
def _(t):
    return occ(t)


@query("majority_label", "occ", MAJORITY.format("occ"))
def _(t):
    return O.majority_label(occ(t))


@query("region_labels_3d", "occ", MAJORITY.format("occ WHERE region_id IN (11, 12, 21, 22)"))
def _(t):
    return O.region_labels_3d(occ(t), [11, 12, 21, 22])


@query("region_labels_flat", "flat_occ", MAJORITY.format("flat_occ"))
def _(t):
    return O.region_labels_flat(occ(t), FLAT)


@query("region_labels_layers", "flat_occ layers", MAJORITY.format("""
(SELECT o.region_id, CASE layer_index WHEN 0 THEN 0 WHEN 3 THEN 40 ELSE 80 END::BIGINT + linear_bin AS linear_bin, n
FROM flat_occ o JOIN layers l ON l.region_id = o.region_id WHERE layer_index IN (0, 3, 4)) x"""))
def _(t):
    return O.region_labels_layers(occ(t), FLAT, R.layer_map(cortex(t)), [0, 3, 4])


relation("cells", "SELECT DISTINCT region_id, linear_bin // 40 AS z, linear_bin % 40 // 8 AS y, linear_bin % 8 AS x FROM occ", "occ")
relation("union_cells", """
SELECT DISTINCT root AS region_id, 0::BIGINT AS z, linear_bin % 40 // 8 AS y, linear_bin % 8 AS x FROM flat_occ
JOIN (SELECT id AS region_id, CASE WHEN structure_id_path LIKE '/1/5/10/%' THEN 10 WHEN structure_id_path LIKE '/1/5/%' THEN 5 END AS root FROM structures) s USING (region_id)
WHERE root IS NOT NULL""", "flat_occ", "structures")
EDGE = """
SELECT region_id, z::DOUBLE AS z, y + oy AS y, x + ox AS x, 0.0::DOUBLE AS dz, dy, dx FROM {0} c,
(VALUES (-1, 0, -0.5::DOUBLE, -0.5::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0, 0.5, 0.5, 0.0, -1.0), (0, -1, 0.5, -0.5, -1.0, 0.0), (0, 1, -0.5, 0.5, 1.0, 0.0)) d(sy, sx, oy, ox, dy, dx)
WHERE NOT EXISTS (SELECT 1 FROM {0} o WHERE o.region_id = c.region_id AND o.z = c.z AND o.y = c.y + sy AND o.x = c.x + sx)"""


@query("region_outlines", "cells", EDGE.format("cells"))
def _(t):
    return O.region_outlines(O.region_bins(occ(t), FLAT))


@query("region_outlines_flat", "union_cells", EDGE.format("union_cells"))
def _(t):
    table = occ(t)
    groups = O.selection_groups(table, R.structures_closure(t.structures), [5, 10])
    return O.region_outlines(O.region_bins(table, FLAT, groups, flat=True))


relation("open_faces", """
SELECT region_id, z, y, x, way FROM cells c, (VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) d(way, sz, sy, sx)
WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.region_id = c.region_id AND o.z = c.z + sz AND o.y = c.y + sy AND o.x = c.x + sx)""", "cells")


@query("region_faces", "open_faces", """
WITH v AS (SELECT DISTINCT region_id, z + az AS z, y + ay AS y, x + ax AS x FROM open_faces, (VALUES (-0.5), (0.5)) p(az), (VALUES (-0.5), (0.5)) q(ay), (VALUES (-0.5), (0.5)) r(ax)
  WHERE CASE way WHEN 0 THEN az < 0 WHEN 1 THEN az > 0 WHEN 2 THEN ay < 0 WHEN 3 THEN ay > 0 WHEN 4 THEN ax < 0 ELSE ax > 0 END)
SELECT region_id, (SELECT count(*) FROM v WHERE v.region_id = f.region_id) AS vertices, 2 * count(*) AS triangles FROM open_faces f GROUP BY region_id""")
def _(t):
    vertices, triangles = O.region_faces(O.region_bins(occ(t), FLAT))
    count = lambda df, name: df.groupBy("region_id").agg(F.count("*").alias(name))
    return count(vertices, "vertices").join(count(triangles, "triangles"), "region_id")


@query("region_components", "cells", """
WITH RECURSIVE reach AS (
  SELECT region_id, z, y, x, z AS z0, y AS y0, x AS x0 FROM cells
  UNION
  SELECT c.region_id, c.z, c.y, c.x, r.z0, r.y0, r.x0 FROM reach r JOIN cells c ON c.region_id = r.region_id
  AND abs(c.z - r.z) + abs(c.y - r.y) + abs(c.x - r.x) = 1),
low AS (SELECT region_id, z, y, x, min(z0 * 1000 + y0 * 10 + x0) AS m FROM reach GROUP BY 1, 2, 3, 4)
SELECT region_id, count(DISTINCT m) AS components FROM low GROUP BY region_id""")
def _(t):
    return O.region_components(O.region_bins(occ(t), FLAT))


# --- profile

def crossing(axis, size):
    return f"""SELECT file_id, node_id, (k * 25.0::DOUBLE - {axis}1) / ({axis}2 - {axis}1) AS t FROM edge, range(0, {size + 1}) r(k)
WHERE {axis}1 <> {axis}2 AND k * 25.0 > least({axis}1, {axis}2) AND k * 25.0 < greatest({axis}1, {axis}2)"""


relation("edge", """
SELECT c.file_id, c.node_id, c.parent_id, c.type, c.x AS x1, c.y AS y1, c.z AS z1, p.x AS x2, p.y AS y2, p.z AS z2,
sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2)) AS len
FROM nodes c JOIN nodes p ON c.file_id = p.file_id AND c.parent_id = p.node_id""", "nodes")
relation("cut", f"""
SELECT file_id, node_id, 0.0::DOUBLE AS t FROM edge UNION ALL SELECT file_id, node_id, 1.0::DOUBLE FROM edge
UNION ALL {crossing('x', 16)} UNION ALL {crossing('y', 10)} UNION ALL {crossing('z', 12)}""", "edge")
relation("portion", """
SELECT *, CASE WHEN mz = 150.0 THEN 'midline' WHEN mz < 150.0 THEN 'lower' ELSE 'upper' END AS side FROM (
SELECT e.*, t0, t1, (t1 - t0) * len AS length_um, x1 + (t0 + t1) / 2 * (x2 - x1) AS mx, y1 + (t0 + t1) / 2 * (y2 - y1) AS my, z1 + (t0 + t1) / 2 * (z2 - z1) AS mz
FROM (SELECT file_id, node_id, t AS t0, lead(t) OVER (PARTITION BY file_id, node_id ORDER BY t) AS t1 FROM cut) c JOIN edge e USING (file_id, node_id)
WHERE t1 - t0 > 3.552713678800501e-15 AND len > 0) q""", "cut", "edge")


@query("split_edges", "portion", """
SELECT file_id, node_id, parent_id, round(t0, 9) AS t0, round(t1, 9) AS t1, round(length_um, 6) AS length_um, side,
CASE WHEN mx >= 0 AND mx < 400 AND my >= 0 AND my < 250 AND mz >= 0 AND mz < 300
THEN (CAST(floor(mx / 25) AS BIGINT) * 10 + CAST(floor(my / 25) AS BIGINT)) * 12 + CAST(floor(mz / 25) AS BIGINT) END AS voxel FROM portion""")
def _(t):
    rows = P.split_edges(T.edges(t.nodes), t.grid)
    return rows.withColumns({"t0": F.round("t0", 9), "t1": F.round("t1", 9), "length_um": F.round("length_um", 6)}).select("file_id", "node_id", "parent_id", "t0", "t1", "length_um", "side", "voxel")


relation("soma_side", "SELECT file_id, min(CASE WHEN z = 150.0 THEN 'midline' WHEN z < 150.0 THEN 'lower' ELSE 'upper' END) AS soma_side FROM nodes WHERE type = 1 AND z >= 0 AND z < 300 GROUP BY file_id", "nodes")
relation("profile", """
WITH r AS (
  SELECT p.file_id, coalesce(a.region_id, 0) AS region_id, side, CASE WHEN type = 1 THEN 'soma' ELSE 'neurite' END AS compartment,
  length_um AS cable, 0 AS n, 0 AS ends FROM portion p
  LEFT JOIN annotation a ON a.ai = floor(mx / 25) AND a.bi = floor(my / 25) AND a.ci = floor(mz / 25)
  UNION ALL
  SELECT n.file_id, region_id, CASE WHEN z = 150.0 THEN 'midline' WHEN z < 150.0 THEN 'lower' ELSE 'upper' END,
  CASE WHEN type = 1 THEN 'soma' ELSE 'neurite' END, 0.0, 1, CASE WHEN type <> 1 AND k.parent_id IS NULL THEN 1 ELSE 0 END
  FROM nodes n LEFT JOIN (SELECT DISTINCT file_id, parent_id FROM nodes) k ON k.file_id = n.file_id AND k.parent_id = n.node_id)
SELECT r.file_id, region_id, CASE WHEN side = 'midline' THEN 'midline' WHEN soma_side IS NULL OR soma_side = 'midline' THEN 'unknown'
  WHEN side = soma_side THEN 'ipsilateral' ELSE 'contralateral' END AS laterality, compartment,
sum(cable) AS cable_length_um, sum(n)::BIGINT AS node_count, sum(ends)::BIGINT AS terminus_count
FROM r LEFT JOIN soma_side USING (file_id) GROUP BY 1, 2, 3, 4""", "portion", "nodes", "annotation", "soma_side")


def tree_nodes(t):
    """The node table as a morphology store holds it: made from the driver's tables once, read many times."""
    return settle(t.nodes.select("file_id", "node_id", "parent_id", "type", "x", "y", "z", "region_id"))


def profile(t):
    return P.build_profile(tree_nodes(t), t.annotation, t.structures, t.grid, validate=False)


@query("build_profile", "profile", """
SELECT file_id, region_id, laterality, compartment, round(cable_length_um, 6) AS cable_length_um, node_count, terminus_count FROM profile""")
def _(t):
    return rounded(P.build_profile(tree_nodes(t), t.annotation, t.structures, t.grid), "cable_length_um")


@query("validate_profile", "profile nodes edge", """
SELECT count(*) AS row_count, count(*) AS unique_keys, sum(node_count)::BIGINT AS node_count, sum(terminus_count)::BIGINT AS terminus_count,
round((SELECT sum(len) FROM edge), 3) AS cable_length_um, 0::BIGINT AS invalid_rows FROM profile""")
def _(t):
    return P.validate_profile(profile(t)).withColumn("cable_length_um", F.round("cable_length_um", 3))


@query("publish_profile", "nodes profile", """
SELECT (SELECT count(*) FROM nodes) AS nodes_n, count(*) AS rows, sum(node_count)::BIGINT AS node_count, sum(terminus_count)::BIGINT AS terminus_count, '' AS stale, 'nodes_n,nodes_sum' AS stale_after FROM profile""")
def _(t):
    path = scratch_path(t.spark, "published")
    tree = tree_nodes(t)
    P.publish_profile(tree, t.annotation, t.structures, t.grid, path)
    whole = P.registered_profile(tree, t.annotation, t.structures, t.grid, path)
    stale = P.stale_facts(tree.filter("node_id <> 2"), t.annotation, t.structures, t.grid, path)
    totals = whole.agg(F.count("*").alias("rows"), F.sum("node_count").alias("node_count"), F.sum("terminus_count").alias("terminus_count"))
    nodes = P.profile_facts(t.spark, path).select("nodes_n").scalar()
    return totals.select(nodes.alias("nodes_n"), "*", F.lit("").alias("stale"), F.lit(",".join(stale)).alias("stale_after"))


# --- queries

def closure(t):
    return R.structures_closure(t.structures)


TREE = AllOf((
    AnyOf((SomaIn(Regions((10,))), NeuriteIn(Regions((20, 41), descendants=True), "contralateral"))),
    Not(Threshold(Regions((40,)), "cable_length_um", ">", 16000.0)),
    Threshold(Regions((5,)), "terminus_count", ">=", 150, laterality="ipsilateral"),
))
LEAVES = """
WITH f AS (SELECT DISTINCT file_id FROM profile),
a AS (SELECT DISTINCT file_id FROM profile WHERE compartment = 'soma' AND node_count > 0 AND region_id IN (10, 11, 12)),
b AS (SELECT DISTINCT file_id FROM profile WHERE compartment = 'neurite' AND (node_count > 0 OR cable_length_um > 0) AND region_id IN (20, 21, 22, 41) AND laterality = 'contralateral'),
c AS (SELECT f.file_id FROM f LEFT JOIN profile p ON p.file_id = f.file_id AND compartment = 'neurite' AND region_id IN (40, 41, 42)
      GROUP BY f.file_id HAVING coalesce(sum(cable_length_um), 0) > 16000.0),
d AS (SELECT f.file_id FROM f LEFT JOIN profile p ON p.file_id = f.file_id AND compartment = 'neurite' AND laterality = 'ipsilateral'
      AND region_id IN (5, 10, 11, 12, 20, 21, 22, 30, 31, 32) GROUP BY f.file_id HAVING coalesce(sum(terminus_count), 0) >= 150)
"""


@query("resolve_selection", "closure nodes", """
SELECT direct_region_id AS region_id, count(n.file_id) AS n FROM (SELECT DISTINCT direct_region_id FROM closure WHERE ancestor_region_id IN (10, 30)) c
LEFT JOIN nodes n ON n.region_id = direct_region_id GROUP BY 1""")
def _(t):
    used = t.nodes.groupBy("region_id").agg(F.count("*").alias("n"))
    return Q.resolve_selection(closure(t), Regions((10, 30))).join(used, "region_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("query_soma_in", "profile", LEAVES + "SELECT file_id FROM a")
def _(t):
    return Q.matching_files(profile(t), closure(t), SomaIn(Regions((10,))))


@query("query_neurite_in", "profile", LEAVES + "SELECT file_id FROM b")
def _(t):
    return Q.matching_files(profile(t), closure(t), TREE.children[0].children[1])


@query("query_threshold", "profile", LEAVES + "SELECT file_id FROM c")
def _(t):
    return Q.matching_files(profile(t), closure(t), TREE.children[1].child)


@query("threshold_left_join", "profile", LEAVES + """
SELECT f.file_id FROM f LEFT JOIN profile p ON p.file_id = f.file_id AND compartment = 'soma' AND region_id IN (31, 32)
GROUP BY f.file_id HAVING coalesce(sum(node_count), 0) <= 0""")
def _(t):
    rows = settle(profile(t))
    condition = Threshold(Regions((31, 32)), "node_count", "<=", 0, compartment="soma")
    return Q.threshold_left_join(rows, rows.select("file_id").distinct(), condition, [31, 32])


@query("query_all_of", "profile", LEAVES + "SELECT file_id FROM b INTERSECT SELECT file_id FROM d")
def _(t):
    return Q.matching_files_by_sets(settle(profile(t)), closure(t), AllOf((TREE.children[0].children[1], TREE.children[2])))


@query("query_any_of", "profile", LEAVES + "SELECT file_id FROM a UNION SELECT file_id FROM c")
def _(t):
    return Q.matching_files_by_sets(settle(profile(t)), closure(t), AnyOf((SomaIn(Regions((10,))), TREE.children[1].child)))


@query("query_not", "profile", LEAVES + "SELECT file_id FROM f EXCEPT SELECT file_id FROM c")
def _(t):
    return Q.matching_files_by_sets(settle(profile(t)), closure(t), TREE.children[1])


MATCHES = LEAVES + """
SELECT file_id, neuron_id, subject, true AS has_catalog FROM (
  (SELECT file_id FROM a UNION SELECT file_id FROM b) EXCEPT SELECT file_id FROM c INTERSECT SELECT file_id FROM d) m
JOIN (SELECT file_id, min(neuron_id) AS neuron_id, min(subject) AS subject FROM nodes GROUP BY file_id) n USING (file_id)""".replace(
    "EXCEPT SELECT file_id FROM c INTERSECT SELECT file_id FROM d", "INTERSECT (SELECT file_id FROM d EXCEPT SELECT file_id FROM c)")


@query("region_query", "profile nodes", MATCHES)
def _(t):
    return Q.region_query(profile(t), closure(t), neuron_catalog(t.nodes), TREE)


@query("region_query_indexed", "profile nodes", MATCHES)
def _(t):
    found = I.indexed_files(I.build_index(settle(profile(t)), closure(t)), TREE)
    names = neuron_catalog(t.nodes).select("file_id", "neuron_id", "subject", F.lit(True).alias("has_catalog"))
    return found.join(names, "file_id")


@query("query_explain", "closure nodes", """
WITH c(path, kind, picked, side) AS (VALUES ('query.children[0].children[0]', 'soma_in', [10], 'either'), ('query.children[0].children[1]', 'neurite_intersects', [20, 41], 'contralateral'),
  ('query.children[1].child', 'regional_threshold', [40], 'either'), ('query.children[2]', 'regional_threshold', [5], 'ipsilateral'))
SELECT path, kind, side AS laterality, (SELECT count(DISTINCT direct_region_id) FROM closure WHERE list_contains(picked, ancestor_region_id))::INT AS resolved,
(SELECT count(*) FROM nodes WHERE region_id IN (SELECT direct_region_id FROM closure WHERE list_contains(picked, ancestor_region_id))) AS n FROM c""")
def _(t):
    rows = Q.query_explain(closure(t), TREE)
    used = t.nodes.groupBy("region_id").agg(F.count("*").alias("n"))
    return rows.select("path", "kind", "laterality", F.size("resolved_ids").alias("resolved"), F.explode("resolved_ids").alias("region_id")).join(
        used, "region_id", "left").groupBy("path", "kind", "laterality", "resolved").agg(F.sum("n").alias("n"))


# --- report

relation("cohort", "SELECT DISTINCT file_id FROM assignments WHERE assignment_id = 'B'", "assignments")
REPORT = """
WITH l AS (SELECT ancestor_region_id, direct_region_id, depth FROM closure UNION ALL SELECT 0, 0, 0),
p AS (SELECT file_id, region_id, laterality, sum(cable_length_um) AS cable, sum(terminus_count) AS t FROM profile JOIN cohort USING (file_id)
  WHERE compartment = 'neurite' AND (node_count > 0 OR cable_length_um > 0) AND region_id NOT IN (40, 41, 42) GROUP BY ALL),
al AS (SELECT false AS is_aggregate, region_id, laterality, file_id, cable, t FROM p
  UNION ALL SELECT true, ancestor_region_id, laterality, file_id, cable, t FROM p JOIN l ON direct_region_id = region_id)
SELECT is_aggregate, region_id, (SELECT ancestor_region_id FROM l WHERE direct_region_id = al.region_id AND depth = 1) AS parent_id,
coalesce(s.name, 'Outside / unmapped') AS name, coalesce(s.acronym, 'unmapped') AS acronym, laterality, count(DISTINCT file_id) AS neurons_present,
round(100.0::DOUBLE * count(DISTINCT file_id) / (SELECT count(*) FROM cohort), 6) AS cohort_present_percent, round(sum(cable) / 1000, 6) AS total_cable_mm,
round(sum(cable) / 1000 / (SELECT count(*) FROM cohort), 6) AS mean_cable_per_cohort_neuron_mm,
round(100.0::DOUBLE * count(DISTINCT CASE WHEN t > 0 THEN file_id END) / (SELECT count(*) FROM cohort), 6) AS neurons_with_termini_percent,
sum(t)::BIGINT AS total_termini FROM al LEFT JOIN structures s ON s.id = region_id GROUP BY ALL"""


def cohort(t):
    return t.assignments.filter("assignment_id = 'B'").select("file_id").distinct()


@query("region_report", "profile closure structures cohort", REPORT)
def _(t):
    report = G.region_report(settle(profile(t)), closure(t), t.structures, cohort(t), split=True, excluded=[40])
    return rounded(report, "cohort_present_percent", "total_cable_mm", "mean_cable_per_cohort_neuron_mm", "neurons_with_termini_percent")


@query("cohort_missing", "profile annotations", """
SELECT file_id FROM annotations EXCEPT SELECT file_id FROM profile WHERE region_id = 11 AND compartment = 'soma'""")
def _(t):
    return G.cohort_missing(profile(t).filter("region_id = 11 AND compartment = 'soma'"), t.annotations)


@query("report_members", "profile closure cohort", """
WITH w(row_region_id, laterality, descendants) AS (VALUES (5, 'contralateral', true), (11, 'ipsilateral', false), (0, 'ipsilateral', true)),
l AS (SELECT ancestor_region_id, direct_region_id, depth FROM closure UNION ALL SELECT 0, 0, 0)
SELECT DISTINCT row_region_id, w.laterality, descendants, file_id FROM w JOIN l ON ancestor_region_id = row_region_id AND (descendants OR depth = 0)
JOIN profile p ON p.region_id = direct_region_id AND p.laterality = w.laterality JOIN cohort USING (file_id)
WHERE compartment = 'neurite' AND (node_count > 0 OR cable_length_um > 0) AND p.region_id <> 12""")
def _(t):
    wanted = [(5, "contralateral", True), (11, "ipsilateral", False), (0, "ipsilateral", True)]
    return G.report_members(profile(t), closure(t), cohort(t), wanted, split=True, excluded=[12])


relation("features", """
SELECT file_id, CASE WHEN region_id IN (20, 21, 22, 30, 31, 32, 11, 12, 10, 5) AND region_id NOT IN (30, 31, 32) THEN CASE WHEN region_id IN (20, 21, 22) THEN 20 ELSE region_id END ELSE region_id END AS group_id,
laterality AS side, sum(cable_length_um) AS value FROM profile JOIN cohort USING (file_id) WHERE compartment = 'neurite' AND region_id NOT IN (41)
GROUP BY 1, 2, 3 HAVING sum(cable_length_um) <> 0""", "profile", "cohort")


@query("regional_features", "features", "SELECT file_id, group_id, side, round(value, 6) AS value FROM features")
def _(t):
    return rounded(G.regional_features(settle(profile(t)), closure(t), cohort(t), "cable", "split", groups=[20, 21], excluded=[41]), "value")


@query("regional_features_reached", "profile cohort", """
SELECT file_id, CASE WHEN region_id IN (10, 11, 12, 20, 21, 22, 30, 31, 32, 5) THEN 5 ELSE region_id END AS group_id, 'combined' AS side, 1.0::DOUBLE AS value
FROM profile JOIN cohort USING (file_id) WHERE compartment = 'neurite' AND (node_count > 0 OR cable_length_um > 0) GROUP BY 1, 2""")
def _(t):
    return G.regional_features(settle(profile(t)), closure(t), cohort(t), "reached", groups=[5, 10, 11])


def distance_features(t, mode="cable"):
    return G.regional_features(settle(profile(t)), closure(t), cohort(t), mode, "split", groups=[20, 21], excluded=[41])


@query("regional_distances", "features", """
WITH s AS (SELECT file_id, sqrt(sum(value * value)) AS n FROM features GROUP BY 1)
SELECT a.file_id AS i, b.file_id AS j, round(greatest(0, least(1, 1 - coalesce((SELECT sum(x.value * y.value) FROM features x JOIN features y USING (group_id, side)
  WHERE x.file_id = a.file_id AND y.file_id = b.file_id), 0) / (a.n * b.n))), 6) AS distance FROM s a JOIN s b ON a.file_id < b.file_id""")
def _(t):
    return rounded(G.regional_distances(distance_features(t)), "distance")


@query("regional_distances_jaccard", "features", """
WITH s AS (SELECT file_id, count(*) AS n FROM features GROUP BY 1),
o AS (SELECT x.file_id AS i, y.file_id AS j, count(*) AS n FROM features x JOIN features y USING (group_id, side) GROUP BY 1, 2)
SELECT a.file_id AS i, b.file_id AS j, round(1 - coalesce(o.n, 0)::DOUBLE / (a.n + b.n - coalesce(o.n, 0)), 6) AS distance
FROM s a JOIN s b ON a.file_id < b.file_id LEFT JOIN o ON o.i = a.file_id AND o.j = b.file_id""")
def _(t):
    return rounded(G.regional_distances(distance_features(t), "jaccard"), "distance")
