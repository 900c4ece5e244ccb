"""Pearson, similarity search and the flatmap."""

import re

from pyspark.sql import functions as F

from ..operators import flatmap as M, pearson as P, regions as R, volumes as V
from ..operators.filters import VoxelNodeFilter
from ..operators.flatmap import FlatGrid, Projection
from ..operators.pairs import all_pairs, symmetric_pairs
from ..plans import search as S
from ..workload.registry import RELATIONS, query, relation
from ..workload.voxels import cortex

relation("stats", "SELECT file_id, sum(c)::DOUBLE AS sx, sum(c * c)::DOUBLE AS sxx FROM counts GROUP BY file_id", "counts")
relation("universe", "SELECT count(*)::DOUBLE AS v FROM (SELECT DISTINCT ai, bi, ci FROM counts) u", "counts")
relation("xy", """SELECT a.file_id AS i, b.file_id AS j, sum(a.c * b.c)::DOUBLE AS sxy FROM counts a
JOIN counts b USING (ai, bi, ci) WHERE a.file_id < b.file_id GROUP BY 1, 2""", "counts")
relation("upper", """
SELECT x.file_id AS i, y.file_id AS j, coalesce(p.sxy, 0) AS sxy, p.sxy IS NOT NULL AS shared, v, x.sx AS sxi, y.sx AS sxj,
v * x.sxx - x.sx * x.sx AS vi, v * y.sxx - y.sx * y.sx AS vj
FROM stats x JOIN stats y ON x.file_id < y.file_id CROSS JOIN universe LEFT JOIN xy p ON p.i = x.file_id AND p.j = y.file_id
""", "stats", "universe", "xy")
relation("corrected", "SELECT i, j, (v * sxy - sxi * sxj) / sqrt(vi * vj) AS r FROM upper WHERE vi > 0 AND vj > 0", "upper")
SQUARE = """SELECT swc_id_1, swc_id_2, round(r, 6) AS r FROM (
SELECT i AS swc_id_1, j AS swc_id_2, r FROM {0} UNION ALL SELECT j, i, r FROM {0}
UNION ALL SELECT file_id, file_id, 1.0 FROM {1}) s"""


def counts(t):
    return V.voxel_counts(t.nodes, 25.0)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("neuron_numbers", "stats", "SELECT file_id, row_number() OVER (ORDER BY file_id) AS swc_num FROM stats")
def _(t):
    return P.neuron_numbers(P.neuron_stats(counts(t)))


@query("pair_cross_products", "xy", "SELECT * FROM xy")
def _(t):
    return P.pair_cross_products(counts(t))


@query("all_pairs", "stats", """
SELECT x.file_id AS i, y.file_id AS j, x.sx AS sx_i, y.sx AS sx_j FROM stats x JOIN stats y ON x.file_id < y.file_id""")
def _(t):
    stats = P.neuron_stats(counts(t)).select("file_id", "sx")
    return all_pairs(stats, stats.count())


@query("ccf_pearson", "corrected stats universe", SQUARE.format("corrected", "stats, universe WHERE v * sxx - sx * sx > 0"))
def _(t):
    return rounded(P.ccf_pearson(counts(t)), "r")


@query("ccf_pearson_legacy", "upper stats", "WITH legacy AS (SELECT i, j, CASE WHEN shared THEN coalesce((v * sxy - sxi * sxj)"
       " / nullif(sqrt(greatest(vi, 0) * greatest(vj, 0)), 0), -1) ELSE -1 END AS r FROM upper)\n" + SQUARE.format("legacy", "stats"))
def _(t):
    return rounded(P.ccf_pearson(counts(t), corrected=False), "r")


@query("corr_matrix", "corrected stats universe", SQUARE.format("corrected", "stats, universe WHERE v * sxx - sx * sx > 0"))
def _(t):
    return rounded(P.corr_matrix(P.ccf_pearson(counts(t))), "r")


@query("symmetric_pairs", "stats", """
SELECT a.file_id AS swc_id_1, b.file_id AS swc_id_2, CASE WHEN a.file_id = b.file_id THEN 0 ELSE abs(a.sx - b.sx) END AS gap
FROM stats a, stats b""")
def _(t):
    stats = P.neuron_stats(counts(t)).select("file_id", "sx")
    pairs = all_pairs(stats, stats.count()).select("i", "j", F.abs(F.col("sx_i") - F.col("sx_j")).alias("gap"))
    return symmetric_pairs(pairs, stats, "gap", 0.0)


# --- search

relation("first_file", "SELECT min(file_id) AS ref FROM counts", "counts")
QUERY = """
WITH q AS (SELECT ai, bi, ci, sum(c)::DOUBLE AS q FROM counts JOIN first_file ON file_id = ref GROUP BY ai, bi, ci),
qs AS (SELECT sum(q) AS sy, sum(q * q) AS syy FROM q)
"""
HITS = QUERY + """,
x AS (SELECT file_id, sum(c)::DOUBLE AS sx, sum(c * c)::DOUBLE AS sxx, coalesce(sum(c * q), 0) AS sxy, count(q) AS n
      FROM counts LEFT JOIN q USING (ai, bi, ci) GROUP BY file_id),
r AS (SELECT file_id, 1 - greatest(-1, least(1, (v * sxy - sx * sy) / sqrt((v * sxx - sx * sx) * (v * syy - sy * sy)))) AS d
      FROM x, qs, universe WHERE v * sxx - sx * sx > 0),
h AS (SELECT * FROM r WHERE file_id <> (SELECT ref FROM first_file) ORDER BY d, file_id LIMIT {0}),
c AS (SELECT file_id, min(neuron_id) AS neuron_id, min(subject) AS subject FROM nodes GROUP BY file_id)
SELECT CAST(row_number() OVER (ORDER BY d, file_id) AS INT) AS rank, file_id, neuron_id, subject, round(d, 6) AS pearson_distance
FROM h JOIN c USING (file_id)"""


def first_file(t):
    return t.nodes.agg(F.min("file_id")).first()[0]


@query("voxel_search_ccf", "counts universe first_file", HITS.format(10))
def _(t):
    return rounded(S.voxel_search(t.nodes, S.VoxelSearch((first_file(t),), top_n=10)), "pearson_distance")


@query("result_rank", "counts universe first_file", HITS.format(25))
def _(t):
    return rounded(S.voxel_search(t.nodes, S.VoxelSearch((first_file(t),), top_n=25), check=False), "pearson_distance")


@query("aggregate_query_join", "counts first_file", QUERY + """
SELECT c.file_id, c.ai, c.bi, c.ci, c.c, coalesce(q.q, 0) AS q FROM counts c LEFT JOIN q USING (ai, bi, ci)""")
def _(t):
    table = counts(t)
    return V.with_indices(S.aggregate_query_join(table, S.aggregate_query(table, [first_file(t)])))


@query("top_n_hits", "counts first_file universe", QUERY + """,
x AS (SELECT file_id, sum(c)::DOUBLE AS sx, sum(c * c)::DOUBLE AS sxx, sum(c * q) AS sxy FROM counts LEFT JOIN q USING (ai, bi, ci) GROUP BY file_id)
SELECT file_id, round(1 - CASE WHEN sxy IS NULL THEN -1 ELSE greatest(-1, least(1, coalesce((v * sxy - sx * sy)
  / nullif(sqrt(greatest(v * sxx - sx * sx, 0) * greatest(v * syy - sy * sy, 0)), 0), -1))) END, 6) AS pearson_distance
FROM x, qs, universe ORDER BY 1 - CASE WHEN sxy IS NULL THEN -1 ELSE greatest(-1, least(1, coalesce((v * sxy - sx * sy)
  / nullif(sqrt(greatest(v * sxx - sx * sx, 0) * greatest(v * syy - sy * sy, 0)), 0), -1))) END, file_id LIMIT 15""")
def _(t):
    return rounded(S.top_n_hits(S.score(counts(t), [first_file(t)], "legacy"), 15), "pearson_distance")


# --- flatmap

GRID = dict(y_bins=10, depth_bin_um=100.0)
VALID = "coalesce(flatmap_shaped_valid, false)"
DEEP = "coalesce(depth_valid, false)"
relation("bounds", f"""SELECT min(x_flat_shaped) AS x0, max(x_flat_shaped) AS x1, min(y_flat_shaped) AS y0, max(y_flat_shaped) AS y1,
min(depth_um) FILTER ({DEEP} AND depth_um >= 0) AS d0, max(depth_um) FILTER ({DEEP} AND depth_um >= 0) AS d1
FROM nodes WHERE {VALID}""", "nodes")
relation("grid", """SELECT *, 10 AS ny, greatest(1, CAST(floor(10 * ((x1 - x0) / (y1 - y0)) + 0.5) AS BIGINT)) AS nx,
greatest(1, CAST(floor((d1 - d0) / 100.0) AS BIGINT) + 1) AS nd FROM bounds""", "bounds")
relation("bins", f"""SELECT n.*, greatest(0, least(ny - 1, CAST(floor((y_flat_shaped - y0) / (y1 - y0) * ny) AS BIGINT))) AS y_bin,
greatest(0, least(nx - 1, CAST(floor((x_flat_shaped - x0) / (x1 - x0) * nx) AS BIGINT))) AS x_bin,
CASE WHEN {DEEP} THEN greatest(0, least(nd - 1, CAST(floor((depth_um - d0) / 100.0) AS BIGINT))) + 1 ELSE 0 END AS depth_bin
FROM nodes n, "grid" WHERE {VALID} AND ({DEEP} OR depth_um = -1.0)""", "nodes", "grid")


def grid(t, **kw):
    return M.grid_for(t.nodes, "shaped", **{**GRID, **kw})


@query("grid_bounds", "bounds", "SELECT x0 AS x_min, x1 AS x_max, y0 AS y_min, y1 AS y_max, d0 AS depth_min, d1 AS depth_max FROM bounds")
def _(t):
    return M.observed_bounds(t.nodes, "shaped")


@query("lookup_stats", "lookup", """
SELECT min(x_flat) FILTER (ok) AS x_min, max(x_flat) FILTER (ok) AS x_max, min(y_flat) FILTER (ok) AS y_min, max(y_flat) FILTER (ok) AS y_max,
min(depth_um) FILTER (depth_um >= 0) AS depth_min, max(depth_um) FILTER (depth_um >= 0) AS depth_max,
count(*) FILTER (ok) AS flatmap_valid_voxels, count(*) FILTER (depth_um >= 0) AS depth_valid_voxels
FROM (SELECT *, NOT (x_flat = -1 AND y_flat = -1) AND NOT (x_flat = 0 AND y_flat = 0) AS ok FROM lookup) l""")
def _(t):
    return M.lookup_stats(t.lookup, zero_sentinel=True)


@query("flatmap_bins", "bins", "SELECT file_id, node_id, depth_bin, y_bin, x_bin FROM bins")
def _(t):
    return M.flatmap_bins(t.nodes, grid(t)).select("file_id", "node_id", "depth_bin", "y_bin", "x_bin")


@query("flatmap_stats", "nodes", f"""
SELECT count(*) AS total_nodes, count(DISTINCT file_id) AS total_traces, count(*) FILTER ({VALID}) AS flatmap_valid_nodes,
count(*) FILTER ({VALID} AND {DEEP}) AS depth_valid_nodes, count(*) FILTER ({VALID} AND depth_um = -1) AS depth_minus_one_nodes,
count(*) FILTER ({VALID} AND ({DEEP} OR depth_um = -1)) AS rendered_nodes,
count(DISTINCT file_id) FILTER ({VALID} AND ({DEEP} OR depth_um = -1)) AS traces_represented FROM nodes""")
def _(t):
    return M.flatmap_stats(t.nodes, grid(t))


@query("flatmap_heatmap", "bins assignments", """
SELECT label AS cluster, depth_bin, y_bin, x_bin, count(*) AS node_count FROM bins b
LEFT JOIN assignments a ON a.file_id = b.file_id AND assignment_id = 'B' GROUP BY ALL""")
def _(t):
    return M.flatmap_heatmap(t.nodes, grid(t), "cluster", t.assignments.filter("assignment_id = 'B'"))


@query("flatmap_heatmap_flat", "bins", "SELECT y_bin, x_bin, count(*) AS node_count FROM bins GROUP BY ALL")
def _(t):
    return M.flatmap_heatmap(t.nodes, grid(t, collapse_depth=True))


@query("flatmap_heatmap_by_file", "bins", "SELECT file_id, depth_bin, y_bin, x_bin, count(*) AS node_count FROM bins GROUP BY ALL")
def _(t):
    return M.flatmap_heatmap(t.nodes, grid(t), "file")


@query("plane_labels", "bins grid", """
SELECT depth_bin::INT AS depth_bin, CASE WHEN depth_bin = 0 THEN 'depth -1' ELSE printf('%g-%g um', d0 + (depth_bin - 1) * 100.0::DOUBLE, d0 + depth_bin * 100.0::DOUBLE) END AS label
FROM "grid", range(20) r(depth_bin) WHERE depth_bin <= nd""")
def _(t):
    return M.plane_labels(grid(t), t.spark)


@query("plane_points", "bins", "SELECT file_id, y_bin, x_bin FROM bins")
def _(t):
    return M.plane_points(t.nodes, grid(t, collapse_depth=True))


@query("flatmap_input_count", "bins", "SELECT count(*) AS node_count, count(DISTINCT file_id) AS file_count FROM bins WHERE type IN (2, 3)")
def _(t):
    return M.flatmap_input_count(t.nodes, grid(t), VoxelNodeFilter("include", (2, 3)))


relation("fcounts", "SELECT file_id, (depth_bin * 1000 + y_bin) * 1000 + x_bin AS voxel, count(*)::DOUBLE AS c FROM bins GROUP BY ALL", "bins")
relation("fstats", "SELECT file_id, sum(c) AS sx, v * sum(c * c) - sum(c) * sum(c) AS var, v FROM fcounts, (SELECT count(DISTINCT voxel)::DOUBLE AS v FROM fcounts) u GROUP BY file_id, v", "fcounts")
relation("flat_r", """
SELECT x.file_id AS i, y.file_id AS j, greatest(-1, least(1, coalesce((x.v * coalesce(sxy, 0) - x.sx * y.sx)
  / nullif(sqrt(greatest(x.var, 0) * greatest(y.var, 0)), 0), 0))) AS r
FROM fstats x JOIN fstats y ON x.file_id < y.file_id LEFT JOIN (SELECT a.file_id AS i, b.file_id AS j, sum(a.c * b.c) AS sxy
FROM fcounts a JOIN fcounts b USING (voxel) WHERE a.file_id < b.file_id GROUP BY 1, 2) p ON p.i = x.file_id AND p.j = y.file_id""", "fcounts", "fstats")


@query("flatmap_pearson", "flat_r", SQUARE.format("flat_r", "fstats"))
def _(t):
    return rounded(M.flatmap_pearson(t.nodes, grid(t)).table(), "r")


FLAT_HITS = """
WITH f AS (SELECT min(file_id) AS ref FROM nodes), q AS (SELECT voxel, c AS q FROM fcounts JOIN f ON file_id = ref),
qs AS (SELECT sum(q) AS sy, sum(q * q) AS syy FROM q),
x AS (SELECT file_id, coalesce(sum(c * q), 0) AS sxy FROM fcounts LEFT JOIN q USING (voxel) GROUP BY file_id),
r AS (SELECT file_id, 1 - greatest(-1, least(1, coalesce((v * sxy - sx * sy) / nullif(sqrt(greatest(var, 0) * greatest(v * syy - sy * sy, 0)), 0), 0))) AS d
      FROM x JOIN fstats USING (file_id), qs),
h AS (SELECT r.* FROM r, f WHERE file_id <> ref ORDER BY d, file_id LIMIT 12)
SELECT CAST(row_number() OVER (ORDER BY d, file_id) AS INT) AS rank, file_id, neuron_id, subject, round(d, 6) AS pearson_distance
FROM h JOIN (SELECT file_id, min(neuron_id) AS neuron_id, min(subject) AS subject FROM nodes GROUP BY file_id) c USING (file_id)"""


@query("voxel_search_flatmap", "fcounts fstats nodes", FLAT_HITS)
def _(t):
    request = S.VoxelSearch((first_file(t),), top_n=12, space="flatmap", flat=grid(t))
    return rounded(S.voxel_search(t.nodes, request), "pearson_distance")


# --- inside and outside masks of voxels

INSIDE = """floor(x / 25) < 12 AND NOT (floor(x / 25) BETWEEN 4 AND 9 AND floor(y / 25) BETWEEN 2 AND 6 AND floor(z / 25) BETWEEN 3 AND 8)"""


def masked(name):
    """The relation of this name, made from masked nodes or bins; its own relations are called ``m_`` too."""
    old, new = RELATIONS[name], f"m_{name}"
    mine = [n for n in ("counts", "bins", "stats", "universe", "first_file", "fcounts", "fstats") if re.search(rf"\b{n}\b", old) and n != name]
    relation(new, in_mask(old), *[f"m_{n}" for n in mine])


def in_mask(sql):
    return re.sub(r"\b(counts|bins|stats|universe|first_file|fcounts|fstats|flat_r)\b", r"m_\1", sql)


relation("m_nodes", f"SELECT * FROM nodes WHERE {INSIDE}", "nodes")
relation("m_bins", f"SELECT * FROM bins WHERE {INSIDE}", "bins")
relation("m_counts", RELATIONS["counts"].replace("FROM nodes", "FROM m_nodes"), "m_nodes")
for _name in ("universe", "first_file", "fcounts", "fstats", "flat_r"):
    masked(_name)


def masks(t):
    return {"include": t.annotation.filter("ai < 12").select("ai", "bi", "ci"), "exclude": t.mask}


@query("voxel_search_ccf_masked", "m_counts m_universe m_first_file nodes", in_mask(HITS.format(10)))
def _(t):
    request = S.VoxelSearch((first_file(t),), top_n=10)
    return rounded(S.voxel_search(t.nodes, request, t.grid, **masks(t)), "pearson_distance")


# Of files of all numbers every third has lost its coordinates.
LOST = "CAST(substr(file_id, 2, length(file_id) - 5) AS BIGINT) % 3 = 2 AND file_id <> (SELECT min(file_id) FROM nodes)"


@query("search_omissions", "m_counts m_universe m_first_file nodes", f"""
WITH c AS (SELECT * FROM m_counts WHERE NOT ({LOST})),
one AS (SELECT file_id, sum(c)::DOUBLE AS sx, sum(c * c)::DOUBLE AS sxx FROM c GROUP BY file_id),
u AS (SELECT count(*)::DOUBLE AS v FROM (SELECT DISTINCT ai, bi, ci FROM c) d)
SELECT file_id, CASE WHEN sx IS NULL THEN 'no usable node' ELSE 'zero variance' END AS reason
FROM (SELECT DISTINCT file_id FROM nodes) f LEFT JOIN one USING (file_id), u WHERE file_id <> (SELECT min(file_id) FROM nodes) AND (sx IS NULL OR v * sxx - sx * sx <= 0)""")
def _(t):
    first = first_file(t)
    number = F.substr("file_id", F.lit(2), F.length("file_id") - 5).cast("long")
    lost = (number % 3 == 2) & (F.col("file_id") != first)
    nodes = t.nodes.withColumn("x", F.when(lost, F.lit(float("nan"))).otherwise(F.col("x")))
    return S.search_omissions(nodes, S.VoxelSearch((first,)), t.grid, **masks(t))


@query("flatmap_pearson_masked", "m_flat_r m_fstats", SQUARE.format("m_flat_r", "m_fstats"))
def _(t):
    return rounded(M.flatmap_pearson(t.nodes, grid(t), voxels=t.grid, **masks(t)).table(), "r")


@query("voxel_search_flatmap_masked", "m_fcounts m_fstats nodes", in_mask(FLAT_HITS))
def _(t):
    request = S.VoxelSearch((first_file(t),), top_n=12, space="flatmap", flat=grid(t))
    return rounded(S.voxel_search(t.nodes, request, t.grid, **masks(t)), "pearson_distance")


# --- projection

relation("direct", """
SELECT n.*, floor(x / 25 + 0.5)::BIGINT AS vi, floor(y / 25 + 0.5)::BIGINT AS vj, floor(z / 25 + 0.5)::BIGINT AS vk FROM nodes n""", "nodes")
relation("projected", """
SELECT d.file_id, d.node_id, d.parent_id, d.type, d.vi, d.vj, d.vk, l.ai IS NOT NULL AS inside, l.x_flat, l.y_flat, l.depth_um,
coalesce(NOT (l.x_flat = -1 AND l.y_flat = -1), false) AS fv, coalesce(l.depth_um >= 0, false) AS dv,
m.ai IS NOT NULL AS m_inside, m.x_flat AS mx, m.y_flat AS my, m.depth_um AS md, coalesce(NOT (m.x_flat = -1 AND m.y_flat = -1), false) AS mfv,
coalesce(m.depth_um >= 0, false) AS mdv, floor((275.0 - z) / 25 + 0.5)::BIGINT AS mk
FROM direct d LEFT JOIN lookup l ON l.ai = vi AND l.bi = vj AND l.ci = vk
LEFT JOIN lookup m ON m.ai = vi AND m.bi = vj AND m.ci = floor((275.0 - z) / 25 + 0.5)""", "direct", "lookup")
relation("chosen", """
SELECT *, fv AND dv AS ok, fv AND NOT dv AND mdv AS take_depth, NOT fv AND mfv AND mdv AS take_all FROM projected""", "projected")
relation("final", """
SELECT file_id, node_id, parent_id, type, CASE WHEN take_all THEN mk ELSE vk END AS voxel_k,
CASE WHEN take_all THEN mx ELSE x_flat END AS x_flat, CASE WHEN take_all THEN my ELSE y_flat END AS y_flat,
CASE WHEN take_all OR take_depth THEN md ELSE depth_um END AS depth_um, fv OR take_all AS flatmap_valid, dv OR take_depth OR take_all AS depth_valid,
ok OR take_depth OR take_all AS valid,
CASE WHEN ok OR take_depth OR take_all THEN '' WHEN NOT inside THEN 'out_of_bounds' WHEN NOT fv THEN 'invalid_flatmap' ELSE 'invalid_depth' END AS invalid_reason,
CASE WHEN ok THEN 'direct' WHEN take_depth THEN 'mirrored_depth' WHEN take_all THEN 'mirrored' ELSE 'unmapped' END AS flatmap_lookup_mode FROM chosen""", "chosen")
KEEP = ("file_id", "node_id", "parent_id", "type")
DONE = ("voxel_k", "x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_valid", "valid", "invalid_reason", "flatmap_lookup_mode")


def projection(t):
    return Projection(t.grid, mirror_midline=137.5)


def projected(t):
    rows = t.nodes.select("file_id", "node_id", "parent_id", "type", "x", "y", "z")
    return M.project_nodes(rows, t.lookup, projection(t), mirror_fallback=True)


@query("project_nodes", "final", "SELECT * FROM final")
def _(t):
    return projected(t).select(*KEEP, *DONE)


@query("projection_summary", "final", """
SELECT count(*) AS total_nodes, count(*) FILTER (valid) AS valid_nodes, count(*) FILTER (invalid_reason = 'missing_input') AS missing_input_nodes,
count(*) FILTER (invalid_reason = 'out_of_bounds') AS out_of_bounds_nodes, count(*) FILTER (invalid_reason = 'invalid_flatmap') AS invalid_flatmap_nodes,
count(*) FILTER (invalid_reason = 'invalid_depth') AS invalid_depth_nodes, count(*) FILTER (flatmap_lookup_mode = 'direct') AS direct_lookup_nodes,
count(*) FILTER (flatmap_lookup_mode = 'mirrored_depth') AS mirrored_depth_lookup_nodes, count(*) FILTER (flatmap_lookup_mode = 'mirrored') AS mirrored_lookup_nodes,
count(*) FILTER (flatmap_lookup_mode = 'unmapped') AS unmapped_lookup_nodes, count(DISTINCT file_id) AS total_traces,
(SELECT count(*) FROM (SELECT file_id FROM final GROUP BY file_id HAVING bool_or(valid) AND NOT bool_and(valid)) p) AS traces_with_partial_projection,
(SELECT count(*) FROM final c JOIN final p ON p.file_id = c.file_id AND p.node_id = c.parent_id WHERE c.valid AND p.valid) AS rendered_segments
FROM final""")
def _(t):
    rows = projected(t)
    return M.projection_summary(rows, M.projected_segments(rows))


@query("projected_segments", "final", """
SELECT c.file_id, c.parent_id, c.node_id, p.x_flat AS x1, p.y_flat AS y1, c.x_flat AS x2, c.y_flat AS y2
FROM final c JOIN final p ON p.file_id = c.file_id AND p.node_id = c.parent_id WHERE c.valid AND p.valid""")
def _(t):
    return M.projected_segments(projected(t))


@query("segment_pixels", "final", """
WITH s AS (SELECT c.file_id, c.parent_id, c.node_id,
greatest(-0.5, least(9.5, (p.y_flat - 0) / 2.25 * 10 - 0.5)) AS r1, greatest(-0.5, least(9.5, (c.y_flat - 0) / 2.25 * 10 - 0.5)) AS r2,
greatest(-0.5, least(16.5, (p.x_flat - 0) / 3.75 * 17 - 0.5)) AS c1, greatest(-0.5, least(16.5, (c.x_flat - 0) / 3.75 * 17 - 0.5)) AS c2
FROM final c JOIN final p ON p.file_id = c.file_id AND p.node_id = c.parent_id WHERE c.valid AND p.valid)
SELECT file_id, parent_id, node_id, r1::REAL AS row, c1::REAL AS column, (r2 - r1)::REAL AS d_row, (c2 - c1)::REAL AS d_column FROM s""")
def _(t):
    return M.segment_pixels(M.projected_segments(projected(t)), FlatGrid("", (0.0, 3.75), (0.0, 2.25), y_bins=10))


CODE = "CASE invalid_reason WHEN '' THEN 0 WHEN 'missing_input' THEN 1 WHEN 'out_of_bounds' THEN 2 WHEN 'invalid_flatmap' THEN 3 ELSE 4 END::TINYINT"


@query("augment_v2", "final", f"""
SELECT file_id, node_id, x_flat::REAL AS x_flat, y_flat::REAL AS y_flat, depth_um::REAL AS depth_um, flatmap_valid, depth_valid,
valid AS flatmap_projection_valid, {CODE} AS flatmap_invalid_code, flatmap_lookup_mode FROM final""")
def _(t):
    return M.augment_v2(t.nodes, t.lookup, projection(t)).select(
        "file_id", "node_id", "x_flat", "y_flat", "depth_um", "flatmap_valid", "depth_valid", "flatmap_projection_valid",
        "flatmap_invalid_code", "flatmap_lookup_mode")


@query("augment_v3", "direct lookup", """
WITH j AS (SELECT d.file_id, d.node_id, l.ai IS NOT NULL AS inside, l.x_flat AS xs, l.y_flat AS ys, l.x_flat * 2 AS xq, l.y_flat * 2 AS yq,
  coalesce(l.depth_um >= 0, false) AS own, coalesce(m.depth_um >= 0, false) AS other, l.depth_um AS d0, m.depth_um AS d1
  FROM direct d LEFT JOIN lookup l ON l.ai = vi AND l.bi = vj AND l.ci = vk LEFT JOIN lookup m ON m.ai = vi AND m.bi = vj AND m.ci = 11 - vk),
k AS (SELECT *, coalesce(NOT (xs = -1 AND ys = -1), false) AS sv, coalesce(NOT (xq = -1 AND yq = -1), false) AS qv, own OR other AS deep FROM j)
SELECT file_id, node_id, CASE WHEN sv THEN xs ELSE 'nan'::DOUBLE END::REAL AS x_flat_shaped, CASE WHEN qv THEN yq ELSE 'nan'::DOUBLE END::REAL AS y_flat_square,
sv AS flatmap_shaped_valid, qv AS flatmap_square_valid, sv AND deep AS flatmap_shaped_projection_valid,
CASE WHEN NOT inside THEN 2 WHEN NOT sv THEN 3 WHEN NOT deep THEN 4 ELSE 0 END::TINYINT AS flatmap_shaped_invalid_code,
CASE WHEN qv THEN 'direct' ELSE 'unmapped' END AS flatmap_square_lookup_mode,
CASE WHEN own THEN d0 WHEN other THEN d1 ELSE 'nan'::DOUBLE END::REAL AS depth_um, deep AS depth_valid,
CASE WHEN NOT inside THEN 2 WHEN NOT deep THEN 4 ELSE 0 END::TINYINT AS depth_invalid_code,
CASE WHEN own THEN 'direct' WHEN other THEN 'mirrored_depth' ELSE 'unmapped' END AS depth_lookup_mode FROM k""")
def _(t):
    double = t.lookup.withColumns({"x_flat": F.col("x_flat") * 2, "y_flat": F.col("y_flat") * 2})
    out = M.augment_v3(t.nodes, t.lookup, double, t.lookup, projection(t))
    return out.select(
        "file_id", "node_id", "x_flat_shaped", "y_flat_square", "flatmap_shaped_valid", "flatmap_square_valid",
        "flatmap_shaped_projection_valid", "flatmap_shaped_invalid_code", "flatmap_square_lookup_mode", "depth_um", "depth_valid",
        "depth_invalid_code", "depth_lookup_mode")


# --- layers and somas

LAYER_BINS = """
WITH b AS (SELECT n.file_id, layer_index, n.region_id, coalesce(flatmap_shaped_valid, false) AS ok,
greatest(0, least(ny - 1, CAST(floor((y_flat_shaped - y0) / (y1 - y0) * ny) AS BIGINT))) AS y_bin,
greatest(0, least(nx - 1, CAST(floor((x_flat_shaped - x0) / (x1 - x0) * nx) AS BIGINT))) AS x_bin
FROM nodes n CROSS JOIN "grid" LEFT JOIN layers l ON l.region_id = n.region_id)
"""


@query("layer_heatmap", "nodes grid layers", LAYER_BINS + """
SELECT CAST(CASE layer_index WHEN 3 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS INT) AS plane, y_bin, x_bin, count(*) AS node_count
FROM b WHERE ok AND layer_index IN (3, 0, 4) GROUP BY ALL""")
def _(t):
    return M.layer_heatmap(t.nodes, R.layer_map(cortex(t)), grid(t), [3, 0, 4])


@query("layer_heatmap_projection", "nodes grid layers", LAYER_BINS + """
SELECT file_id, y_bin, x_bin, count(*) AS node_count FROM b WHERE ok AND layer_index IS NOT NULL GROUP BY ALL""")
def _(t):
    return M.layer_heatmap(t.nodes, R.layer_map(cortex(t)), grid(t), stack=False, by="file")


@query("layer_stats", "nodes grid layers", LAYER_BINS + """
SELECT count(*) AS total_nodes, count(DISTINCT file_id) AS total_traces, count(*) FILTER (ok) AS flatmap_valid_nodes,
count(layer_index) AS layer_classified_nodes, count(*) FILTER (ok AND layer_index IN (0, 3)) AS rendered_nodes,
count(DISTINCT file_id) FILTER (ok AND layer_index IN (0, 3)) AS traces_represented,
count(*) FILTER (ok AND layer_index NOT IN (0, 3)) AS excluded_unselected_layer_nodes FROM b""")
def _(t):
    return M.layer_stats(t.nodes, R.layer_map(cortex(t)), grid(t), [0, 3])


relation("flat_somas", f"""
SELECT file_id, avg(x_flat_shaped) FILTER ({VALID} AND {DEEP}) AS x_flat, avg(y_flat_shaped) FILTER ({VALID} AND {DEEP}) AS y_flat,
avg(depth_um) FILTER ({VALID} AND {DEEP}) AS depth_um, avg(x) AS x, avg(y) AS y, avg(z) AS z,
count(*) FILTER ({VALID} AND {DEEP}) AS soma_node_count FROM nodes WHERE type = 1 GROUP BY file_id
HAVING count(*) FILTER ({VALID} AND {DEEP}) > 0""", "nodes")


@query("flatmap_soma_coords", "flat_somas", "SELECT * FROM flat_somas")
def _(t):
    return M.flatmap_soma_coords(t.nodes, "shaped")


@query("normalize_soma", "flat_somas bounds", """
SELECT file_id, round(x_flat / (y1 - y0), 6) AS x, round(y_flat / (y1 - y0), 6) AS y, round(depth_um / (d1 - d0) * 0.5, 6) AS z, 'observed' AS bounds_source
FROM flat_somas, bounds""")
def _(t):
    coords = M.normalize_soma(M.flatmap_soma_coords(t.nodes, "shaped"), M.grid_bounds(t.nodes, "shaped"), 0.5)
    return rounded(coords, "x", "y", "z")
