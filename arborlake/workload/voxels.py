"""Voxel volumes, masks, regions, hemispheres."""

from pyspark.sql import functions as F

from ..operators import hemisphere as H, regions as R, volumes as V
from ..operators.filters import VoxelNodeFilter
from ..workload.listings import FINITE, IDX
from ..workload.registry import query, relation

INSIDE = "ai >= 0 AND ai < 16 AND bi >= 0 AND bi < 10 AND ci >= 0 AND ci < 12"
relation("heat", f"SELECT ai, bi, ci, count(*) AS n FROM (SELECT {IDX} FROM nodes WHERE {FINITE}) v WHERE {INSIDE} GROUP BY ai, bi, ci", "nodes")
relation("axons", f"SELECT ai, bi, ci, count(*) AS n FROM (SELECT {IDX} FROM nodes WHERE type = 2 AND {FINITE}) v WHERE {INSIDE} GROUP BY ai, bi, ci", "nodes")
relation("counts", f"SELECT file_id, ai, bi, ci, count(*) AS c FROM (SELECT file_id, {IDX} FROM nodes WHERE {FINITE}) v GROUP BY file_id, ai, bi, ci", "nodes")


def heat(t):
    return V.heatmap_counts(t.nodes, t.grid)


def axons(t):
    return V.heatmap_counts(t.nodes, t.grid, node_types=[2])


@query("voxel_counts", "counts", "SELECT * FROM counts")
def _(t):
    return V.with_indices(V.voxel_counts(t.nodes, 25.0))


LUT = "(SELECT ai, bi, ci, CASE WHEN region_id IN (11, 12) THEN ai * 120 + bi * 12 + ci ELSE -1 END AS voxel_id FROM annotation)"


@query("voxel_lut_join", "nodes annotation", f"""
SELECT file_id, CAST(voxel_id AS BIGINT) AS voxel, count(*) AS c FROM (SELECT file_id, {IDX} FROM nodes WHERE {FINITE}) v
JOIN {LUT} l USING (ai, bi, ci) WHERE voxel_id >= 0 GROUP BY file_id, voxel_id""")
def _(t):
    lut = t.annotation.withColumn("voxel_id", F.when(F.col("region_id").isin(11, 12), t.grid.linear()).otherwise(-1))
    return V.lut_counts(t.nodes, t.grid, lut)


@query("dense_voxel_ids", "heat", """
SELECT ai, bi, ci, row_number() OVER (ORDER BY ai, bi, ci) - 1 AS voxel_id FROM heat""")
def _(t):
    return V.with_indices(V.dense_voxel_ids(V.voxel_counts(t.nodes, 25.0)))


@query("heatmap_counts", "nodes", f"""
WITH s AS (SELECT file_id, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM nodes WHERE type = 1 GROUP BY file_id)
SELECT ai, bi, ci, count(*) AS n FROM (
  SELECT CAST(floor(x / 75.0) AS BIGINT) AS ai, CAST(floor(y / 25.0) AS BIGINT) AS bi, CAST(floor(z / 25.0) AS BIGINT) AS ci
  FROM nodes JOIN s USING (file_id)
  WHERE region_id IN (11, 12, 21, 31) AND type IN (2, 3) AND sqrt(pow(x - sx, 2) + pow(y - sy, 2) + pow(z - sz, 2)) <= 180.0) v
WHERE ai BETWEEN 0 AND 5 AND bi BETWEEN 0 AND 9 AND ci BETWEEN 0 AND 11 GROUP BY ai, bi, ci""")
def _(t):
    return V.heatmap_counts(t.nodes, t.grid, [11, 12, 21, 31], None, [2, 3], 180.0, 3, 0)


@query("search_heatmap", "nodes mask", f"""
SELECT ai, bi, ci, count(*) AS n FROM (SELECT type, {IDX} FROM nodes WHERE {FINITE}
  AND file_id IN (SELECT file_id FROM nodes WHERE type IN (3, 4))) v
WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.ai = v.ai AND m.bi = v.bi AND m.ci = v.ci) AND (type IS NULL OR type NOT IN (1))
AND {INSIDE} GROUP BY ai, bi, ci""")
def _(t):
    return V.search_heatmap(t.nodes, t.grid, exclude=t.mask, node_filter=VoxelNodeFilter("exclude", (1,), require_dendrites=True))


@query("correlation_input_count", "nodes mask", f"""
SELECT count(*) AS node_count, count(DISTINCT file_id) AS file_count FROM (SELECT file_id, type, {IDX} FROM nodes WHERE {FINITE}) v
WHERE type IN (2, 4) AND EXISTS (SELECT 1 FROM mask m WHERE m.ai = v.ai AND m.bi = v.bi AND m.ci = v.ci)""")
def _(t):
    return V.input_count(V.scoped_nodes(t.nodes, t.grid, include=t.mask, node_filter=VoxelNodeFilter("include", (2, 4))))


@query("mask_union", "mask annotation", """
SELECT ai, bi, ci FROM mask UNION SELECT ai, bi, ci FROM annotation WHERE region_id IN (21, 22)""")
def _(t):
    return V.mask_union([t.mask, t.annotation.filter("region_id IN (21, 22)")])


@query("mask_intersection", "mask annotation", """
SELECT ai, bi, ci FROM mask INTERSECT SELECT ai, bi, ci FROM annotation WHERE region_id IN (21, 22)""")
def _(t):
    return V.mask_intersection(t.mask, t.annotation.filter("region_id IN (21, 22)"))


@query("merge_heatmaps", "heat axons", """
SELECT ai, bi, ci, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM heat UNION ALL SELECT * FROM axons) u GROUP BY ai, bi, ci""")
def _(t):
    return V.merge_heatmaps([heat(t), axons(t)])


@query("threshold_range", "heat", "SELECT ai, bi, ci FROM heat WHERE n >= 20 AND n <= 40")
def _(t):
    return V.threshold_range(heat(t), "n", 20, 40)


@query("isolate_regions", "heat annotation", """
SELECT h.* FROM heat h WHERE EXISTS (SELECT 1 FROM annotation a WHERE a.region_id IN (31, 41) AND a.ai = h.ai AND a.bi = h.bi AND a.ci = h.ci)""")
def _(t):
    return V.isolate_regions(heat(t), t.annotation, [31, 41])


@query("reduce_volume", "heat", """
SELECT 'slab' AS reduction, ai AS "row", ci AS "column", CAST(sum(n) AS BIGINT) AS n FROM heat
WHERE abs(bi * 25.0 - 100.0) <= 30.0 GROUP BY ai, ci
UNION ALL
SELECT 'whole', bi, ai, CAST(sum(n) AS BIGINT) FROM heat GROUP BY bi, ai""")
def _(t):
    slab = V.reduce_volume(heat(t), t.grid, "horizontal", slab=True, position=100.0, thickness=60.0)
    whole = V.reduce_volume(heat(t), t.grid, "sagittal")
    return slab.withColumn("reduction", F.lit("slab")).unionByName(whole.withColumn("reduction", F.lit("whole")))


def _smooth_sql(sigma):
    """A Gaussian cut at four sigma, along one axis after the other; beyond the edge the edge's value goes on."""
    radius = int(4 * sigma + 0.5)
    bell = f"exp(-k * k / (2.0::DOUBLE * {sigma} * {sigma}))"
    sql, source = f"WITH w AS (SELECT k, {bell} / sum({bell}) OVER () AS w FROM range({-radius}, {radius + 1}) r(k)),\n", "heat"
    for step, (axis, size) in enumerate((("ai", 16), ("bi", 10), ("ci", 12))):
        cols = ", ".join(f"greatest(0, least({size - 1}, t.{axis} + k)) AS {axis}" if c == axis else f"t.{c}" for c in ("ai", "bi", "ci"))
        frame = "SELECT a.ai, b.bi, c.ci FROM range(16) a(ai), range(10) b(bi), range(12) c(ci)"
        on = " AND ".join(f"s.{c} = " + (f"greatest(0, least({size - 1}, t.{axis} + k))" if c == axis else f"t.{c}") for c in ("ai", "bi", "ci"))
        sql += f"s{step} AS (SELECT t.ai, t.bi, t.ci, sum(s.n * w) AS n FROM ({frame}) t, w, {source} s WHERE {on} GROUP BY t.ai, t.bi, t.ci),\n"
        source = f"s{step}"
    return sql.rstrip(",\n") + "\n"


@query("smooth_heatmap", "heat", _smooth_sql(0.7) + "SELECT ai, bi, ci, round(n, 6) AS n FROM s2")
def _(t):
    return V.smooth_heatmap(heat(t), t.grid, 0.7).withColumn("n", F.round("n", 6))


@query("histogram_shared", "heat axons", """
WITH v AS (SELECT 'all' AS name, CAST(n AS REAL) AS v FROM heat UNION ALL SELECT 'axon', CAST(n AS REAL) FROM axons),
b AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM v),
e AS (SELECT i, CAST(CASE WHEN i = 32 THEN hi ELSE lo + i * ((hi - lo) / 32) END AS REAL) AS edge FROM b, range(33) r(i))
SELECT name, CAST(a.i AS INT) AS bin, a.edge::DOUBLE AS lower, z.edge::DOUBLE AS upper, count(*) AS count
FROM v JOIN e a ON v.v >= a.edge JOIN e z ON z.i = a.i + 1 AND (v.v < z.edge OR (z.i = 32 AND v.v <= z.edge))
GROUP BY name, a.i, a.edge, z.edge""")
def _(t):
    volumes = heat(t).select("n", F.lit("all").alias("name")).unionByName(axons(t).select("n", F.lit("axon").alias("name")))
    return V.histogram_shared(volumes, bins=32)


OTSU = """
WITH v AS (SELECT CAST(n AS REAL) AS v FROM {0} WHERE n > 0), b AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, least(256, count(*)) AS k FROM v),
e AS (SELECT i, k, CAST(CASE WHEN i = k THEN hi ELSE lo + i * ((hi - lo) / k) END AS REAL) AS edge FROM b, range(257) r(i) WHERE i <= k),
h AS (SELECT a.i, CAST((a.edge + z.edge) * 0.5::REAL AS REAL)::DOUBLE AS centre,
      (SELECT count(*) FROM v WHERE v.v >= a.edge AND (v.v < z.edge OR (z.i = a.k AND v.v <= z.edge)))::DOUBLE AS h
      FROM e a JOIN e z ON z.i = a.i + 1),
c AS (SELECT i, centre, sum(h) OVER up AS w1, sum(h * centre) OVER up AS s1, sum(h) OVER dn - h AS w2, sum(h * centre) OVER dn AS s2 FROM h
      WINDOW up AS (ORDER BY i ROWS UNBOUNDED PRECEDING), dn AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
m AS (SELECT i, centre, w1, CASE WHEN w1 > 0 THEN s1 / w1 ELSE 0 END AS m1, w2, CASE WHEN w2 > 0 THEN s2 / w2 ELSE 0 END AS m2 FROM c),
x AS (SELECT i, centre, w1 * lead(w2) OVER (ORDER BY i) * pow(m1 - lead(m2) OVER (ORDER BY i), 2) AS g FROM m),
th AS (SELECT centre AS threshold FROM x WHERE g IS NOT NULL ORDER BY g DESC, i LIMIT 1)
"""


@query("otsu_threshold", "heat", OTSU.format("heat") + "SELECT round(threshold, 6) AS threshold FROM th")
def _(t):
    return V.otsu_threshold(heat(t)).select(F.round("threshold", 6).alias("threshold"))


@query("heatmap_to_mask", "heat", _smooth_sql(0.7) + "," + OTSU.format("s2").strip()[4:] + """
SELECT ai, bi, ci FROM s2 WHERE CAST(n AS REAL)::DOUBLE >= (SELECT threshold FROM th)""")
def _(t):
    return V.heatmap_to_mask(heat(t), t.grid, 0.7)[1]


# --- regions

relation("region_rows", "SELECT region_id, count(*) AS n FROM nodes GROUP BY region_id", "nodes")

@query("structures_closure", "closure region_rows", """
SELECT c.*, coalesce(l.n, 0) AS n FROM closure c LEFT JOIN region_rows l ON l.region_id = direct_region_id""")
def _(t):
    used = t.nodes.groupBy(F.col("region_id").alias("direct_region_id")).agg(F.count("*").alias("n"))
    return R.structures_closure(t.structures).join(used, "direct_region_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))



@query("annotate_regions", "nodes annotation structures", """
SELECT n.file_id, n.node_id, coalesce(a.region_id, 0) AS region_id, s.name AS region_name, s.acronym AS region_acronym FROM nodes n
LEFT JOIN annotation a ON a.ai = CAST(trunc(x / 25) AS BIGINT) AND a.bi = CAST(trunc(y / 25) AS BIGINT) AND a.ci = CAST(trunc(z / 25) AS BIGINT)
LEFT JOIN structures s ON s.id = coalesce(a.region_id, 0)""")
def _(t):
    return R.annotate_regions(t.nodes, t.annotation, t.structures, t.grid).select(
        "file_id", "node_id", "region_id", "region_name", "region_acronym")


@query("represented_regions", "nodes closure", """
SELECT DISTINCT ancestor_region_id AS region_id FROM closure
WHERE direct_region_id IN (SELECT region_id FROM nodes)""")
def _(t):
    return R.represented_regions(t.nodes, R.structures_closure(t.structures))


@query("region_descendants", "closure nodes", """
SELECT ancestor_region_id AS selected_id, direct_region_id AS region_id, count(n.file_id) AS n FROM closure
LEFT JOIN nodes n ON n.region_id = direct_region_id WHERE ancestor_region_id IN (5, 40) GROUP BY ALL""")
def _(t):
    found = R.region_descendants(R.structures_closure(t.structures), [5, 40])
    used = t.nodes.groupBy("region_id").agg(F.count("*").alias("n"))
    return found.join(used, "region_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("region_mask", "annotation closure", """
SELECT ai, bi, ci FROM annotation WHERE region_id IN (SELECT direct_region_id FROM closure WHERE ancestor_region_id IN (10, 42))""")
def _(t):
    return R.region_mask(t.annotation, R.structures_closure(t.structures), [10, 42])


DILATE = """
WITH RECURSIVE m AS (SELECT ai, bi, ci FROM annotation WHERE region_id IN (SELECT direct_region_id FROM closure WHERE ancestor_region_id = 20)),
d AS (SELECT a.ai, a.bi, a.ci, min(sqrt(pow((a.ai - m.ai) * 25.0, 2) + pow((a.bi - m.bi) * 25.0, 2) + pow((a.ci - m.ci) * 25.0, 2))) AS d
      FROM annotation a, m GROUP BY a.ai, a.bi, a.ci),
v AS (SELECT count(*)::DOUBLE AS v0, count(*) * (1.0::DOUBLE + 0.3) AS target FROM m),
up(t) AS (SELECT 25.0::DOUBLE UNION ALL SELECT t * 2 FROM up WHERE (SELECT count(*) FROM d WHERE d <= t) < (SELECT target FROM v) AND t < 10000),
hi AS (SELECT max(t) AS hi FROM up),
s(i, lo, hi, best, err, done) AS (
  SELECT 0, 0.0::DOUBLE, hi, hi, abs((SELECT count(*) FROM d WHERE d <= hi.hi) - (SELECT target FROM v)), false FROM hi
  UNION ALL
  SELECT i + 1, CASE WHEN done OR n >= target THEN lo ELSE mid END, CASE WHEN done OR n < target THEN hi ELSE mid END,
         CASE WHEN done THEN best WHEN n BETWEEN target * 0.999 AND target * 1.001 OR abs(n - target) < err THEN mid ELSE best END,
         CASE WHEN done THEN err ELSE least(err, abs(n - target)) END, done OR n BETWEEN target * 0.999 AND target * 1.001
  FROM (SELECT s.*, 0.5 * (lo + hi) AS mid, (SELECT count(*) FROM d WHERE d <= 0.5 * (s.lo + s.hi)) AS n, (SELECT target FROM v) AS target FROM s) q
  WHERE i < 60),
best AS (SELECT best FROM s WHERE i = 60)
"""


@query("dilate_mask", "annotation closure", DILATE + "SELECT ai::BIGINT AS ai, bi::BIGINT AS bi, ci::BIGINT AS ci FROM d WHERE d = 0 OR d <= (SELECT best FROM best)")
def _(t):
    return R.dilate_mask(R.region_mask(t.annotation, R.structures_closure(t.structures), [20]), t.grid, 0.3)


@query("expanded_region_ids", "annotation closure", DILATE + """SELECT ai::BIGINT AS ai, bi::BIGINT AS bi, ci::BIGINT AS ci,
row_number() OVER (ORDER BY ai, bi, ci) - 1 AS voxel_id FROM d WHERE d = 0 OR d <= (SELECT best FROM best)""")
def _(t):
    return R.expanded_region_ids(t.annotation, R.structures_closure(t.structures), t.grid, [20], 0.3)


@query("region_rule_filter", "annotation closure", """
SELECT 'include' AS role, ai, bi, ci FROM annotation
WHERE region_id IN (SELECT direct_region_id FROM closure WHERE ancestor_region_id IN (10, 30))
UNION ALL SELECT 'exclude', ai, bi, ci FROM annotation WHERE region_id = 12""")
def _(t):
    rules = [R.RegionRule(10), R.RegionRule(30), R.RegionRule(12, include=False)]
    include, exclude = R.region_rule_filter(t.annotation, R.structures_closure(t.structures), t.grid, rules)
    return include.withColumn("role", F.lit("include")).unionByName(exclude.withColumn("role", F.lit("exclude")))


@query("neurons_in_mask", "nodes mask", f"""
SELECT file_id, min(neuron_id) AS neuron_id, min(subject) AS subject FROM (SELECT *, {IDX} FROM nodes WHERE {FINITE}) n
WHERE type IN (2, 3) AND EXISTS (SELECT 1 FROM mask m WHERE m.ai = n.ai AND m.bi = n.bi AND m.ci = n.ci) GROUP BY file_id""")
def _(t):
    return neurons_in_mask(t.nodes, t.grid, [t.mask], node_types=[2, 3])


def neurons_in_mask(nodes, grid, masks, **kw):
    from ..plans.mask_query import neurons_in_masks
    return neurons_in_masks(nodes, grid, masks, **kw)


@query("physical_midline", "nodes annotation", """
WITH h AS (SELECT *, CASE WHEN ci < 6 THEN 2 ELSE 1 END AS code FROM annotation)
SELECT min(ci) * 25.0::DOUBLE AS midline_um FROM h WHERE code = 1""")
def _(t):
    codes = t.annotation.withColumn("code", F.when(F.col("ci") < 6, 2).otherwise(1))
    return t.spark.createDataFrame([(R.physical_midline(codes, t.grid),)], "midline_um double")


CORTEX = """(SELECT id, acronym, name, structure_id_path FROM structures UNION ALL
 SELECT * FROM (VALUES (23, 'B6b', 'Area B/Layer 6B', '/1/5/20/23/'), (24, 'Bx', 'Area B, other', '/1/5/20/24/')) x)"""


def cortex(t):
    more = t.spark.createDataFrame(
        [(23, "B6b", "Area B/Layer 6B", "/1/5/20/23/"), (24, "Bx", "Area B, other", "/1/5/20/24/")], t.structures.schema)
    return t.structures.unionByName(more)


relation("layers", f"""
SELECT id AS region_id, CAST(list_position(['1', '2/3', '4', '5', '6a', '6b'], lower(regexp_extract(name, '(,|/)\\s*(layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 3, 'i'))) - 1 AS INT) AS layer_index,
'L' || lower(regexp_extract(name, '(,|/)\\s*(layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 3, 'i')) AS layer_label, name, acronym
FROM {CORTEX} c WHERE structure_id_path LIKE '/1/5/%' AND id NOT IN (5, 10, 20, 30)
AND regexp_matches(name, '(,|/)\\s*(layer\\s+)?(2/3|6a|6b|1|4|5)\\s*$', 'i')""", "structures")


@query("layer_map", "layers nodes", """
SELECT l.region_id, layer_index, layer_label, name, acronym, count(n.file_id) AS n FROM layers l
LEFT JOIN nodes n ON n.region_id = l.region_id GROUP BY ALL""")
def _(t):
    used = t.nodes.groupBy("region_id").agg(F.count("*").alias("n"))
    rows = R.layer_hierarchy(cortex(t), R.layer_map(cortex(t)))
    return rows.join(used, "region_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- hemispheres and mirrored tables

SIDES = """
WITH s AS (SELECT file_id, avg(z) AS m FROM nodes WHERE type = 1 GROUP BY file_id),
o AS (SELECT file_id, CASE WHEN abs(m - 150.0) < 1.0 THEN 'midline' WHEN m < 150.0 THEN 'already target' ELSE 'flipped' END AS outcome FROM s)
"""


@query("align_hemisphere", "nodes", SIDES + """
SELECT n.file_id, node_id, type, x, y, CASE WHEN outcome = 'flipped' THEN 300.0 - z ELSE z END AS z, outcome
FROM nodes n JOIN o ON n.file_id = o.file_id""")
def _(t):
    rows, sides = H.align_hemisphere(t.nodes, "left", 150.0)
    return rows.select("file_id", "node_id", "type", "x", "y", "z").join(sides.select("file_id", "outcome"), "file_id")


def shifted_copy(t):
    """A mirrored table with a few regions renamed, so that the checks have something to find."""
    rows = H.mirror_nodes(t.named_nodes, 150.0)
    odd = F.col("node_id") % 13 == 0
    return rows.withColumns({
        "region_id": F.when(odd, 12).otherwise(F.col("region_id")),
        "region_acronym": F.when(odd, "A2/3").otherwise(F.col("region_acronym"))})


relation("copied", """SELECT * REPLACE (300.0 - z AS z, CASE WHEN node_id % 13 = 0 THEN 12 ELSE region_id END AS region_id,
CASE WHEN node_id % 13 = 0 THEN 'A2/3' ELSE region_acronym END AS region_acronym) FROM named""", "named")


@query("positional_compare", "named copied", """
SELECT l.file_id, l.node_id, l.z AS left_z, r.z AS right_z, l.region_id AS left_region, r.region_id AS right_region
FROM named l JOIN copied r ON l.file_id = r.file_id AND l.node_id = r.node_id""")
def _(t):
    return H.positional_compare(t.named_nodes, shifted_copy(t)).select(
        "file_id", "node_id", F.col("l.z").alias("left_z"), F.col("r.z").alias("right_z"),
        F.col("l.region_id").alias("left_region"), F.col("r.region_id").alias("right_region"))


@query("mirror_qa", "named copied", """
SELECT count(*) AS total_rows, count(*) FILTER (abs(l.x - r.x) > 1e-6) AS diff_x, count(*) FILTER (abs(l.z - r.z) > 1e-6) AS diff_z,
count(*) FILTER (l.type IS DISTINCT FROM r.type) AS diff_type, count(*) FILTER (l.region_id IS DISTINCT FROM r.region_id) AS diff_region_id,
count(*) FILTER (l.region_acronym IS DISTINCT FROM r.region_acronym) AS diff_region_acronym,
count(*) FILTER (abs(l.z - r.z) <= 1e-6) AS equal_axis_rows, min(l.z + r.z) AS min_axis_sum, max(l.z + r.z) AS max_axis_sum,
300.0::DOUBLE AS expected_axis_sum, count(*) FILTER (abs(l.z + r.z - 300.0) > 1e-6) AS bad_mirror_sum,
round(max(abs(l.z + r.z - 300.0)), 6) AS max_mirror_error
FROM named l JOIN copied r ON l.file_id = r.file_id AND l.node_id = r.node_id""")
def _(t):
    row = H.mirror_qa(t.named_nodes, shifted_copy(t))
    return row.select(
        "total_rows", "diff_x", "diff_z", "diff_type", "diff_region_id", "diff_region_acronym", "equal_axis_rows", "min_axis_sum",
        "max_axis_sum", "expected_axis_sum", "bad_mirror_sum", F.round("max_mirror_error", 6).alias("max_mirror_error"))


@query("top_remaps", "named copied", """
SELECT l.region_acronym AS left_region, r.region_acronym AS right_region, count(*) AS count
FROM named l JOIN copied r ON l.file_id = r.file_id AND l.node_id = r.node_id
WHERE l.region_id IS DISTINCT FROM r.region_id GROUP BY 1, 2 ORDER BY count DESC, 1 NULLS FIRST, 2 LIMIT 5""")
def _(t):
    return H.top_remaps(H.positional_compare(t.named_nodes, shifted_copy(t)), 5)
