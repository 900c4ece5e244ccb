"""Clustering, comparison, neuron sets, points, readers and writers."""

import re

from pyspark.sql import functions as F

from ..functions import neuron_of, origin_form, subject_of
from ..operators import catalog as C, clustering as K, compare as A, flatmap as M, points as O, sets as N, volumes as V
from ..operators.filters import AnnotationRule
from ..operators.pearson import pearson
from ..operators.profile import write_profile
from ..plans import search as S
from ..session import scratch_path, settle
from ..sources import nodes as SN, points as SP, results as SR
from ..streaming import appends
from ..workload.anatomy import profile
from ..workload.listings import NODE_COLS
from ..workload.registry import RELATIONS, query, relation
from ..workload.similarity import counts, first_file, projected, rounded

# --- clustering

relation("somas", "SELECT file_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nodes WHERE type = 1 GROUP BY file_id", "nodes")
relation("soma_d", """SELECT a.file_id AS i, b.file_id AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance
FROM somas a JOIN somas b ON a.file_id < b.file_id""", "somas")


def somas(t):
    return C.soma_centroids(t.nodes)


def soma_pairs(t):
    rows = settle(somas(t))
    return K.soma_distances(rows), rows.select("file_id")


@query("soma_distances", "soma_d", "SELECT i, j, round(distance, 6) AS distance FROM soma_d")
def _(t):
    return rounded(soma_pairs(t)[0], "distance")


@query("soma_kmeans", "somas", "SELECT count(*) AS somas, least(5, count(*)) AS clusters, 0::BIGINT AS nearer_to_another FROM somas")
def _(t):
    coords = settle(somas(t))
    return kmeans_check(settle(K.soma_kmeans(coords, 5).join(coords, "file_id")))


@query("soma_dbscan", "soma_d somas", """
WITH RECURSIVE e AS (SELECT i, j FROM soma_d WHERE distance <= 60 UNION ALL SELECT j, i FROM soma_d WHERE distance <= 60 UNION ALL SELECT file_id, file_id FROM somas),
core AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 4),
reach AS (SELECT i, i AS j FROM core UNION SELECT r.i, e.j FROM reach r JOIN e ON e.i = r.j JOIN core c ON c.i = e.j),
low AS (SELECT i, min(j) AS m FROM reach GROUP BY i),
numbered AS (SELECT i, 1 + dense_rank() OVER (ORDER BY m) AS label FROM low),
border AS (SELECT e.i, min(n.label) AS label FROM e JOIN numbered n ON n.i = e.j WHERE e.i NOT IN (SELECT i FROM core) GROUP BY e.i)
SELECT s.file_id, coalesce(n.label, b.label, 1)::INT AS label FROM somas s LEFT JOIN numbered n ON n.i = s.file_id LEFT JOIN border b ON b.i = s.file_id""")
def _(t):
    return K.soma_dbscan(somas(t), 60.0, 4)


relation("flat_d", """
WITH p AS (SELECT file_id, x_flat / (y1 - y0) AS x, y_flat / (y1 - y0) AS y, depth_um / (d1 - d0) AS z FROM flat_somas, bounds)
SELECT a.file_id AS i, b.file_id AS j FROM p a, p b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.2""", "flat_somas", "bounds")


@query("flatmap_soma_clusters", "flat_d", """
WITH RECURSIVE core AS (SELECT i FROM flat_d GROUP BY i HAVING count(*) >= 3),
reach AS (SELECT i, i AS j FROM core UNION SELECT r.i, e.j FROM reach r JOIN flat_d e ON e.i = r.j JOIN core c ON c.i = e.j),
low AS (SELECT i, min(j) AS m FROM reach GROUP BY i),
numbered AS (SELECT i, 1 + dense_rank() OVER (ORDER BY m) AS label FROM low),
border AS (SELECT e.i, min(n.label) AS label FROM flat_d e JOIN numbered n ON n.i = e.j WHERE e.i NOT IN (SELECT i FROM core) GROUP BY e.i)
SELECT s.i AS file_id, coalesce(n.label, b.label, 1)::INT AS label FROM (SELECT DISTINCT i FROM flat_d) s
LEFT JOIN numbered n ON n.i = s.i LEFT JOIN border b ON b.i = s.i""")
def _(t):
    coords = M.normalize_soma(M.flatmap_soma_coords(t.nodes, "shaped"), M.grid_bounds(t.nodes, "shaped"))
    return K.soma_dbscan(coords, 0.2, 3)


relation("flat_xyz", "SELECT file_id, x_flat / (y1 - y0) AS x, y_flat / (y1 - y0) AS y, depth_um / (d1 - d0) AS z FROM flat_somas, bounds", "flat_somas", "bounds")
relation("flat_pairs", """SELECT a.file_id AS i, b.file_id AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance
FROM flat_xyz a JOIN flat_xyz b ON a.file_id < b.file_id""", "flat_xyz")


def flat_coords(t):
    return M.normalize_soma(M.flatmap_soma_coords(t.nodes, "shaped"), M.grid_bounds(t.nodes, "shaped"))


def kmeans_check(rows):
    """Every point is nearest to the mean of its own cluster, which is what k-means ends with."""
    means = rows.groupBy("label").agg(*[F.avg(c).alias(c) for c in "xyz"])
    centres = means.agg(F.collect_list(F.struct("label", *"xyz"))).scalar()
    gap = lambda m: sum((F.pow(F.col(c) - m[c], F.lit(2.0)) for c in "yz"), F.pow(F.col("x") - m["x"], F.lit(2.0)))
    best = rows.withColumn("centres", centres).select(
        "label", F.array_min(F.transform("centres", gap)).alias("least"),
        F.array_min(F.transform(F.filter("centres", lambda m: m["label"] == F.col("label")), gap)).alias("own"))
    return best.agg(F.count("*").alias("somas"), F.count_distinct("label").alias("clusters"), F.count_if(F.col("own") > F.col("least") * 1.00001 + 1e-9).alias("nearer_to_another"))


@query("soma_kmeans_labels")
def _(t):
    return K.soma_kmeans(settle(somas(t)), 5)


@query("flatmap_soma_kmeans_labels")
def _(t):
    return K.soma_kmeans(settle(flat_coords(t).select("file_id", *"xyz")), 4)


@query("flatmap_soma_kmeans", "flat_xyz", "SELECT count(*) AS somas, least(4, count(*)) AS clusters, 0::BIGINT AS nearer_to_another FROM flat_xyz")
def _(t):
    coords = settle(flat_coords(t).select("file_id", *"xyz"))
    return kmeans_check(settle(K.soma_kmeans(coords, 4).join(coords, "file_id")))


def correlation_tree(t, method="average"):
    found = pearson(counts(t))
    ids = settle(found.ids)
    return K.hierarchical(found.distances(), ids, method)


# Single linkage in SQL: a spanning tree of smallest edges has the merges, and the largest edge between two neurons the
# height that first joins them.
relation("r_d", "SELECT i, j, 1 - r AS distance FROM corrected", "corrected")


def spanning(name, distances):
    relation(f"{name}_tree", f"""
SELECT u, v, d FROM (
WITH RECURSIVE grown(seen, u, v, d) AS (
  SELECT [(SELECT min(i) FROM {distances})], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE
  UNION ALL
  SELECT list_append(seen, nxt.e.v), nxt.e.u, nxt.e.v, nxt.e.d FROM grown, LATERAL (
    SELECT arg_min({{'u': p, 'v': q, 'd': distance}}, distance) AS e FROM (
      SELECT CASE WHEN list_contains(seen, i) THEN i ELSE j END AS p, CASE WHEN list_contains(seen, i) THEN j ELSE i END AS q, distance
      FROM {distances} WHERE list_contains(seen, i) <> list_contains(seen, j)) c) nxt WHERE nxt.e IS NOT NULL)
SELECT u, v, d FROM grown WHERE u IS NOT NULL) t""", distances)
    relation(f"{name}_height", f"""
SELECT a, b, h FROM (
WITH RECURSIVE edge2 AS (SELECT u AS a, v AS b, d FROM {name}_tree UNION ALL SELECT v, u, d FROM {name}_tree),
path(a, b, prev, h) AS (SELECT a, b, a, d FROM edge2 UNION ALL
  SELECT p.a, e.b, p.b, greatest(p.h, e.d) FROM path p JOIN edge2 e ON e.a = p.b AND e.b <> p.prev)
SELECT a, b, h FROM path UNION ALL SELECT DISTINCT a, a, -1.0 FROM edge2) t""", f"{name}_tree")


spanning("soma", "soma_d")
spanning("r", "r_d")
spanning("flat", "flat_pairs")
CUT = """
SELECT a AS file_id, dense_rank() OVER (ORDER BY m)::INT AS label FROM (SELECT a, min(b) AS m FROM r_height
WHERE a = b OR h <= (SELECT d FROM r_tree ORDER BY d DESC LIMIT 1 OFFSET {0}) GROUP BY a) c"""


MET = "(p.a IN (e.a, e.b) OR p.b IN (e.a, e.b))"  # pairs with a cluster that merges
OWN = "CASE WHEN p.a IN (e.a, e.b) THEN p.na ELSE p.nb END"
OTHER = "CASE WHEN p.a IN (e.a, e.b) THEN p.nb ELSE p.na END"
AVERAGE = f"sum(p.s * CASE WHEN {MET} THEN {OWN} ELSE 1 END) / sum(CASE WHEN {MET} THEN {OWN} ELSE 1 END)"
WARD = f"CASE WHEN bool_or({MET}) THEN (sum(p.s * ({OWN} + {OTHER})) - any_value({OTHER}) * e.s) / (e.na + e.nb + any_value({OTHER})) ELSE any_value(p.s) END"


def merging(distances, fold, height="e.s", start="distance"):
    """Merges one at a time: the state is the list of all pairs of clusters, named by their smallest member, with their sizes."""
    return f"""
WITH RECURSIVE m(step, a, b, height, size, pairs) AS (
  SELECT 0, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::BIGINT, (SELECT list({{'a': i, 'b': j, 's': {start}, 'na': 1::BIGINT, 'nb': 1::BIGINT}}) FROM {distances})
  UNION ALL
  SELECT step + 1, e.a, e.b, {height}, e.na + e.nb, nxt.pairs FROM (
    SELECT step, pairs, list_sort(list_transform(pairs, lambda p: {{'s': p.s, 'a': p.a, 'b': p.b, 'na': p.na, 'nb': p.nb}}))[1] AS e FROM m WHERE len(pairs) > 0) q, LATERAL (
    SELECT list({{'a': a, 'b': b, 's': s, 'na': na, 'nb': nb}}) AS pairs FROM (
      SELECT least(p1, q1) AS a, greatest(p1, q1) AS b, {fold} AS s,
             any_value(CASE WHEN least(p1, q1) = e.a THEN e.na + e.nb WHEN least(p1, q1) = p.a THEN p.na ELSE p.nb END) AS na,
             any_value(CASE WHEN greatest(p1, q1) = e.a THEN e.na + e.nb WHEN greatest(p1, q1) = p.a THEN p.na ELSE p.nb END) AS nb
      FROM (SELECT p, CASE WHEN p.a = e.b THEN e.a ELSE p.a END AS p1, CASE WHEN p.b = e.b THEN e.a ELSE p.b END AS q1 FROM (SELECT unnest(q.pairs) AS p) u) v
      WHERE p1 <> q1 GROUP BY ALL) w) nxt)"""


MERGES = "\nSELECT a AS left_id, b AS right_id, round(height, 6) AS height, size FROM m WHERE step > 0"
# A cluster that merges goes to the one with the smaller first member; what never goes on is the first of its cluster.
AT_MOST = """,
kept AS (SELECT a, b FROM m WHERE step > 0 AND height <= (SELECT height FROM m WHERE step > 0 ORDER BY height DESC LIMIT 1 OFFSET {0})),
up(file_id, r) AS (SELECT a, a FROM (SELECT a FROM m WHERE step > 0 UNION SELECT b FROM m WHERE step > 0) u UNION ALL SELECT file_id, a FROM up JOIN kept ON b = r)
SELECT file_id, dense_rank() OVER (ORDER BY r)::INT AS label FROM up WHERE r NOT IN (SELECT b FROM kept)"""


def merges(tree):
    return rounded(tree.merges.select("left_id", "right_id", "height", "size"), "height")


@query("hierarchical", "soma_d", merging("soma_d", WARD, "sqrt(e.s)", "distance * distance") + MERGES)
def _(t):
    return merges(K.hierarchical(*soma_pairs(t), "ward"))


@query("hierarchical_average", "r_d", merging("r_d", AVERAGE) + MERGES)
def _(t):
    return merges(correlation_tree(t))


@query("hierarchical_complete", "r_d", merging("r_d", "max(p.s)") + MERGES)
def _(t):
    return merges(correlation_tree(t, "complete"))


@query("cut_clusters_average", "r_d", merging("r_d", AVERAGE) + AT_MOST.format(4))
def _(t):
    return K.cut_clusters(correlation_tree(t), 5)


@query("hierarchical_single", "soma_d somas", """
WITH RECURSIVE mst(step, seen, height) AS (
  SELECT 0, [(SELECT min(file_id) FROM somas)], NULL::DOUBLE
  UNION ALL
  SELECT step + 1, list_append(seen, nxt.f), nxt.d FROM mst, LATERAL (
    SELECT arg_min(f, d) AS f, min(d) AS d FROM (SELECT CASE WHEN list_contains(seen, i) THEN j ELSE i END AS f, distance AS d FROM soma_d
    WHERE list_contains(seen, i) <> list_contains(seen, j)) c) nxt WHERE len(seen) < (SELECT count(*) FROM somas))
SELECT round(height, 6) AS height, count(*) AS merges FROM mst WHERE height IS NOT NULL GROUP BY 1""")
def _(t):
    tree = K.hierarchical(*soma_pairs(t), "single")
    return tree.merges.groupBy(F.round("height", 6).alias("height")).agg(F.count("*").alias("merges"))


@query("flatmap_soma_hierarchical", "flat_tree", "SELECT round(d, 6) AS height, count(*) AS merges FROM flat_tree GROUP BY 1")
def _(t):
    coords = settle(flat_coords(t))
    tree = K.hierarchical(K.soma_distances(coords), coords.select("file_id"), "single")
    return tree.merges.groupBy(F.round("height", 6).alias("height")).agg(F.count("*").alias("merges"))


@query("cut_clusters", "r_tree r_height", CUT.format(4))
def _(t):
    return K.cut_clusters(correlation_tree(t, "single"), 5)


@query("cut_clusters_exact", "r_tree r_height", CUT.format(6))
def _(t):
    return K.cut_clusters(correlation_tree(t, "single"), 7, exact=True)


relation("r_order", """
WITH low AS (SELECT x.a, x.b, min(y.b) AS m FROM r_height x JOIN r_height y ON y.a = x.a AND y.h < x.h WHERE x.a <> x.b GROUP BY x.a, x.b)
SELECT l.a AS file_id, count(*) FILTER (r.m < l.m) AS position FROM low l JOIN low r ON r.a = l.b AND r.b = l.a GROUP BY l.a""", "r_height")
relation("r_label", CUT.format(3), "r_tree", "r_height")


@query("leaf_order", "r_order", "SELECT file_id, position FROM r_order")
def _(t):
    return K.leaf_order(correlation_tree(t, "single"))


@query("cophenetic_spearman", "soma_height r_height", """
WITH both_h AS (SELECT s.h AS h1, r.h AS h2 FROM soma_height s JOIN r_height r USING (a, b) WHERE a < b),
ranked AS (SELECT rank() OVER (ORDER BY h1) + (count(*) OVER (PARTITION BY h1) - 1) / 2.0 AS r1,
                  rank() OVER (ORDER BY h2) + (count(*) OVER (PARTITION BY h2) - 1) / 2.0 AS r2 FROM both_h)
SELECT round(corr(r1, r2), 6) AS spearman, count(*) AS pairs FROM ranked""")
def _(t):
    return rounded(K.cophenetic_spearman(K.hierarchical(*soma_pairs(t), "single"), correlation_tree(t, "single")), "spearman")


@query("compare_partitions", "soma_tree soma_height r_tree r_height", """
WITH ks AS (SELECT k::INT AS k, (SELECT list(d ORDER BY d DESC) FROM soma_tree)[k] AS t1, (SELECT list(d ORDER BY d DESC) FROM r_tree)[k] AS t2 FROM range(2, 21) r(k)),
la AS (SELECT k, a AS f, min(b) AS a FROM ks, soma_height WHERE a = b OR h <= t1 GROUP BY k, a),
lb AS (SELECT k, a AS f, min(b) AS b FROM ks, r_height WHERE a = b OR h <= t2 GROUP BY k, a),
cell AS (SELECT k, a, b, count(*)::DOUBLE AS n FROM la JOIN lb USING (k, f) GROUP BY ALL),
ra AS (SELECT k, a, sum(n) AS m FROM cell GROUP BY ALL), rb AS (SELECT k, b, sum(n) AS m FROM cell GROUP BY ALL),
q AS (SELECT k, (SELECT sum(n) FROM cell c WHERE c.k = ks.k) AS t, (SELECT sum(n * (n - 1) / 2) FROM cell c WHERE c.k = ks.k) AS pij,
  (SELECT sum(m * (m - 1) / 2) FROM ra c WHERE c.k = ks.k) AS pa, (SELECT sum(m * (m - 1) / 2) FROM rb c WHERE c.k = ks.k) AS pb,
  (SELECT sum(n * ln(n)) FROM cell c WHERE c.k = ks.k) AS lij, (SELECT sum(m * ln(m)) FROM ra c WHERE c.k = ks.k) AS la,
  (SELECT sum(m * ln(m)) FROM rb c WHERE c.k = ks.k) AS lb, (SELECT count(*) FROM ra c WHERE c.k = ks.k) AS ka, (SELECT count(*) FROM rb c WHERE c.k = ks.k) AS kb FROM ks)
SELECT k, round(CASE WHEN pij = pa AND pij = pb THEN 1 ELSE (pij - pa * pb / (t * (t - 1) / 2)) / nullif((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2), 0) END, 6) AS ari,
round(CASE WHEN ka = 1 AND kb = 1 THEN 1 WHEN (lij - la - lb) / t + ln(t) <= 1e-12 THEN 0
  ELSE ((lij - la - lb) / t + ln(t)) / nullif((ln(t) - la / t + ln(t) - lb / t) / 2, 0) END, 6) AS nmi FROM q""")
def _(t):
    return rounded(A.compare_partitions(K.hierarchical(*soma_pairs(t), "single"), correlation_tree(t, "single")), "ari", "nmi")


@query("matrix_contrast", "soma_d", """
SELECT round(min(distance), 6) AS minimum, round(max(distance), 6) AS maximum, round(quantile_cont(distance, 0.01), 6) AS lower,
round(quantile_cont(distance, 0.99), 6) AS upper FROM soma_d""")
def _(t):
    found = V.matrix_contrast(settle(soma_pairs(t)[0]))
    names = ("minimum", "maximum", "lower", "upper")
    return rounded(t.spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names)), *names)


@query("ordered_distances", "r_d r_order r_label", """
WITH cells AS (SELECT i, j, distance FROM r_d UNION ALL SELECT file_id, file_id, 0.0 FROM r_order),
leaf AS (SELECT file_id, position, label FROM r_order JOIN r_label USING (file_id))
SELECT i, j, round(distance, 6) AS distance, p.position AS "row", p.label AS row_label, q.position AS "column", q.label AS column_label
FROM cells JOIN leaf p ON p.file_id = i JOIN leaf q ON q.file_id = j""")
def _(t):
    tree = correlation_tree(t, "single")
    pairs = pearson(counts(t)).pairs.select("i", "j", (1.0 - F.col("r")).alias("distance"))
    return rounded(K.ordered_distances(pairs, tree, K.cut_clusters(tree, 4)), "distance")


@query("cluster_table", "named r_order r_label", """
WITH facts AS (
SELECT file_id, max(neuron_id) AS neuron_id, max(subject) AS subject, avg(x) FILTER (type = 1) AS soma_x_um, avg(y) FILTER (type = 1) AS soma_y_um,
avg(z) FILTER (type = 1) AS soma_z_um, max(region_acronym) FILTER (type = 1) AS soma_region_acronym FROM named GROUP BY file_id)
SELECT position + 1 AS dendrogram_order, label AS cluster_assignment, facts.* FROM r_order JOIN r_label USING (file_id) JOIN facts USING (file_id)""")
def _(t):
    tree = correlation_tree(t, "single")
    return SR.cluster_table(t.named_nodes, tree, K.cut_clusters(tree, 4))


# --- comparison of labels

relation("la", "SELECT file_id, label AS a FROM assignments WHERE assignment_id = 'A'", "assignments")
relation("lb", "SELECT file_id, label AS b FROM assignments WHERE assignment_id = 'B'", "assignments")
relation("joint", "SELECT a, b, count(*)::DOUBLE AS n FROM la JOIN lb USING (file_id) GROUP BY a, b", "la", "lb")
relation("scores", """
WITH ra AS (SELECT a, sum(n) AS m FROM joint GROUP BY a), rb AS (SELECT b, sum(n) AS m FROM joint GROUP BY b),
q AS (SELECT (SELECT sum(n) FROM joint) AS t, (SELECT sum(n * (n - 1) / 2) FROM joint) AS pij, (SELECT sum(m * (m - 1) / 2) FROM ra) AS pa,
 (SELECT sum(m * (m - 1) / 2) FROM rb) AS pb, (SELECT -sum(m / t * ln(m / t)) FROM ra, (SELECT sum(n) AS t FROM joint)) AS ha,
 (SELECT -sum(m / t * ln(m / t)) FROM rb, (SELECT sum(n) AS t FROM joint)) AS hb,
 (SELECT sum(n / t * ln(n * t / (ra.m * rb.m))) FROM joint JOIN ra USING (a) JOIN rb USING (b), (SELECT sum(n) AS t FROM joint)) AS mi)
SELECT t, (pij - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)) AS ari, mi / ((ha + hb) / 2) AS nmi FROM q""", "joint")
relation("mutual", """
SELECT a, b, n FROM joint j WHERE b = (SELECT arg_min(b, b) FROM joint k WHERE k.a = j.a AND k.n = (SELECT max(n) FROM joint m WHERE m.a = j.a))
AND a = (SELECT min(a) FROM joint k WHERE k.b = j.b AND k.n = (SELECT max(n) FROM joint m WHERE m.b = j.b))""", "joint")


def run(t, name):
    return t.assignments.filter(F.col("assignment_id") == name).select("file_id", "label")


# a reference run without its third cluster, and cohorts that overlap in part
relation("la2", "SELECT * FROM la WHERE a <> 3", "la")
for _name, _needs in (("joint", ("la2", "lb")), ("scores", ("joint2",)), ("mutual", ("joint2",))):
    relation(f"{_name}2", re.sub(r"\b(la|joint)\b", r"\g<1>2", RELATIONS[_name]), *_needs)


@query("compare_memberships", "scores2 mutual2 la2 lb annotations", """
WITH f AS (SELECT file_id, a IS NOT NULL AS ra, b IS NOT NULL AS cb, tags <> '[]' OR a IS NOT NULL AS rc, n.label < '2' OR b IS NOT NULL AS cc
  FROM annotations n LEFT JOIN la2 USING (file_id) LEFT JOIN lb USING (file_id)),
c AS (SELECT count(*) FILTER (rc) AS reference_cohort, count(*) FILTER (cc) AS candidate_cohort, count(*) FILTER (rc AND cc) AS shared_cohort,
  count(*) FILTER (rc AND NOT cc) AS reference_cohort_only, count(*) FILTER (cc AND NOT rc) AS candidate_cohort_only,
  count(*) FILTER (rc AND cc AND ra AND cb) AS assigned_in_both, count(*) FILTER (rc AND cc AND ra AND NOT cb) AS reference_assigned_only,
  count(*) FILTER (rc AND cc AND cb AND NOT ra) AS candidate_assigned_only, count(*) FILTER (rc AND cc AND NOT ra AND NOT cb) AS unassigned_in_both FROM f)
SELECT c.*, round(ari, 6) AS ari, round(nmi, 6) AS nmi, (SELECT sum(n) FROM mutual2)::BIGINT AS matched_file_ids,
round((SELECT sum(n) FROM mutual2) / assigned_in_both, 6) AS mutual_agreement, 'ok' AS status FROM c, scores2""")
def _(t):
    some, others = t.annotations.filter("tags <> '[]'").select("file_id"), t.annotations.filter("label < '2'").select("file_id")
    out = A.compare_memberships(run(t, "A").filter("label <> 3"), run(t, "B"), some, others)
    return rounded(out, "ari", "nmi", "mutual_agreement")


@query("cluster_matches", "mutual la lb", """
WITH sa AS (SELECT a, count(*) AS n FROM la GROUP BY a), sb AS (SELECT b, count(*) AS n FROM lb GROUP BY b)
SELECT sa.a AS reference_label, sb.b AS candidate_label, coalesce(m.n, 0)::BIGINT AS intersection, coalesce(sa.n, 0) AS reference_size,
coalesce(sb.n, 0) AS candidate_size, coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(m.n, 0)::BIGINT AS "union",
round(coalesce(m.n, 0) / (coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(m.n, 0)), 6) AS jaccard
FROM sa LEFT JOIN mutual m ON m.a = sa.a FULL OUTER JOIN sb ON sb.b = m.b""")
def _(t):
    everyone = t.annotations.select("file_id")
    return rounded(A.cluster_matches(run(t, "A"), run(t, "B"), everyone, everyone), "jaccard")


@query("compare_runs", "scores mutual la lb", """
SELECT t::BIGINT AS total, (t - (SELECT sum(n) FROM mutual))::BIGINT AS moved, round(1 - (SELECT sum(n) FROM mutual) / t, 6) AS changed_fraction,
(SELECT count(*) FROM la JOIN lb USING (file_id) WHERE a <> b) AS raw_changed, round(ari, 6) AS ari FROM scores""")
def _(t):
    return rounded(A.compare_runs(run(t, "A"), run(t, "B")), "changed_fraction", "ari")


OVERLAP = """
SELECT count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (a AND b) AS intersection, count(*) AS "union",
count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only,
round(count(*) FILTER (a AND b)::DOUBLE / nullif(count(*), 0), 6) AS jaccard,
round(2 * count(*) FILTER (a AND b)::DOUBLE / nullif(count(*) FILTER (a) + count(*) FILTER (b), 0), 6) AS dice,
round(count(*) FILTER (a AND b)::DOUBLE / nullif(count(*) FILTER (a), 0), 6) AS fraction_a,
round(count(*) FILTER (a AND b)::DOUBLE / nullif(count(*) FILTER (b), 0), 6) AS fraction_b FROM {0} WHERE a OR b"""


@query("membership_overlap", "nodes", OVERLAP.format(
    "(SELECT file_id, bool_or(type = 4) AS a, bool_or(region_id = 41 AND type = 2) AS b FROM nodes GROUP BY file_id) o"))
def _(t):
    pick = lambda test: t.nodes.filter(test).select("file_id")
    out = A.membership_overlap(pick("type = 4"), pick("region_id = 41 AND type = 2"))
    return rounded(out, "jaccard", "dice", "fraction_a", "fraction_b")


@query("mask_overlap", "annotation mask", OVERLAP.format(
    "(SELECT a.*, region_id IN (21, 22) AS a, m.ai IS NOT NULL AS b FROM annotation a LEFT JOIN mask m ON m.ai = a.ai AND m.bi = a.bi AND m.ci = a.ci) o"))
def _(t):
    out = A.mask_overlap(t.annotation.filter("region_id IN (21, 22)"), t.mask)
    return rounded(out, "jaccard", "dice", "fraction_a", "fraction_b")


@query("shared_maxima", "nodes", """
SELECT key, greatest(max(observed), 0) AS maximum FROM (SELECT region_id AS key, file_id, count(*)::DOUBLE AS observed FROM nodes
WHERE file_id <> 'n00001.swc' GROUP BY 1, 2) o GROUP BY key""")
def _(t):
    cells = t.nodes.groupBy(F.col("region_id").alias("key"), "file_id").agg(F.count("*").alias("observed"))
    return A.shared_maxima(cells.withColumn("override", F.when(F.col("file_id") == "n00001.swc", 1.0)))


# --- sets and stored runs

def entries(t):
    return t.annotations.withColumn("tags", SR.decode_tags("tags"))


@query("neuron_sets", "annotations", """
SELECT 'both' AS set_name, file_id FROM annotations WHERE tags = '["a","b"]'
UNION ALL SELECT 'only b', file_id FROM annotations WHERE tags = '["b"]'
UNION ALL SELECT 'single', file_id FROM annotations WHERE tags IN ('["a"]', '["b"]')
UNION ALL SELECT 'untagged', file_id FROM annotations WHERE tags = '[]'""")
def _(t):
    rule = AnnotationRule
    return N.set_members(entries(t), [
        N.NeuronSet("both", rule(tags=("a", "b"), match="exact")), N.NeuronSet("only b", rule(tags="b", excluded=("a",))),
        N.NeuronSet("single", rule(count="single")), N.NeuronSet("untagged", rule(tags=""))])


@query("tag_groups", "annotations", """
SELECT CASE tags WHEN '[]' THEN '' WHEN '["a"]' THEN 'a' WHEN '["b"]' THEN 'b' ELSE 'a,b' END AS tag_key, count(*) AS neurons FROM annotations GROUP BY 1""")
def _(t):
    return N.tag_groups(entries(t)).select("tag_key", "neurons")


@query("table_summary", "annotations lb", """
WITH x AS (SELECT n.file_id, b AS label, n.tags <> '[]' AS added, n.label < '2' AS visible FROM annotations n LEFT JOIN lb USING (file_id))
SELECT 'rows' AS section, NULL::INT AS key, count(*) AS value FROM x UNION ALL SELECT 'added', NULL, count(*) FILTER (added) FROM x
UNION ALL SELECT 'visible', NULL, count(*) FILTER (visible) FROM x UNION ALL SELECT 'cluster', label, count(*) FROM x GROUP BY label""")
def _(t):
    rows = t.annotations.select("file_id", (F.col("tags") != "[]").alias("added"), (F.col("label") < "2").alias("visible"))
    return N.table_summary(rows.join(run(t, "B"), "file_id", "left"))


def stored(t):
    empty = t.spark.createDataFrame([], "assignment_id string, file_id string, label int")
    cohort = t.annotations.select("file_id")
    runs = N.Assignments(empty, empty.select("assignment_id", "file_id"))
    return runs.add("A", run(t, "A"), cohort, "Soma 1", "cluster_soma_1").add("B", run(t, "B"), cohort, "Soma 2", "cluster_soma_2", scope="whole")


@query("cluster_assignments", "annotations lb", """
SELECT 'Soma 2' AS name, file_id, b AS label FROM annotations LEFT JOIN lb USING (file_id)""")
def _(t):
    runs = stored(t)
    return runs.label_map("B").withColumn("name", F.lit(runs.runs[-1]["name"]))


@query("save_cluster_group", "lb", "SELECT 'third' AS name, 3 AS cluster_label, file_id FROM lb WHERE b = 3")
def _(t):
    path = scratch_path(t.spark, "group")
    SR.save_cluster_group(run(t, "B"), 3, "third", path)
    return t.spark.read.schema("name string, cluster_label int, file_id string").json(path)


# --- points

@query("validate_points", "points", """
SELECT label, x, y, z, region_name, acronym, id::BIGINT AS id, hemisphere, origin_csv FROM points""")
def _(t):
    text = t.points.withColumns({c: F.col(c).cast("string") for c in "xyz"}).withColumns({
        "label": F.concat(F.lit("  "), "label", F.lit(" ")), "id": F.coalesce(F.col("id").cast("string"), F.lit(" "))})
    return SP.validate_points(text)


@query("points_selection", "points", """
SELECT label, x, y, z, id, origin_csv FROM points WHERE (label = 'error' AND origin_csv = 'f2.csv') OR (label = 'click' AND origin_csv = '')""")
def _(t):
    return O.points_selection(t.points, [("error", "f2.csv"), (" click ", None)]).select("label", "x", "y", "z", "id", "origin_csv")


@query("point_group_summary", "points", """
SELECT label, CASE WHEN origin_csv = '' THEN '(not recorded)' ELSE origin_csv END AS origin_csv, count(*) AS point_count FROM points GROUP BY 1, 2""")
def _(t):
    return O.point_group_summary(t.points)


RINT = "round_even(z / 25, 0)::BIGINT AS ai, round_even(y / 25, 0)::BIGINT AS bi, round_even(x / 25, 0)::BIGINT AS ci"


@query("point_heatmaps", "points", f"""
SELECT label, ai, bi, ci, count(*) AS n FROM (SELECT label, {RINT} FROM points) p WHERE ai < 16 AND bi < 10 AND ci < 12 GROUP BY ALL""")
def _(t):
    return O.point_heatmaps(t.points, t.grid)


relation("checked", f"""
WITH p AS (SELECT *, {RINT} FROM points), j AS (
SELECT p.*, coalesce(a.region_id, 0) AS atlas_id, CASE WHEN z < 136.5 THEN 'left' WHEN z > 138.5 THEN 'right' ELSE 'midline' END AS side
FROM p LEFT JOIN annotation a ON a.ai = p.ai AND a.bi = p.bi AND a.ci = p.ci)
SELECT label, x, y, z, id, hemisphere, atlas_id::INT AS atlas_id, side AS atlas_hemisphere,
concat_ws(',', CASE WHEN id IS NOT NULL AND id <> atlas_id THEN 'id' END, CASE WHEN hemisphere IS NOT NULL AND hemisphere <> side THEN 'hemisphere' END) AS mismatch_fields FROM j""",
         "points", "annotation")


@query("validate_points_atlas", "checked", "SELECT * FROM checked WHERE mismatch_fields <> ''")
def _(t):
    rows = O.mismatches(O.validate_points_atlas(t.points, t.annotation, t.structures, t.grid))
    return rows.select("label", "x", "y", "z", "id", "hemisphere", "atlas_id", "atlas_hemisphere", "mismatch_fields")


@query("point_mismatch_counts", "checked", """
SELECT count(*) AS total_points, count(*) FILTER (mismatch_fields <> '') AS mismatched_rows, count(*) FILTER (contains(mismatch_fields, 'id')) AS id_mismatches,
0::BIGINT AS acronym_mismatches, 0::BIGINT AS region_name_mismatches, count(*) FILTER (contains(mismatch_fields, 'hemisphere')) AS hemisphere_mismatches FROM checked""")
def _(t):
    return O.mismatch_counts(O.validate_points_atlas(t.points, t.annotation, t.structures, t.grid))


POINT_COLS = "label, x, y, z, region_name, acronym, id::BIGINT AS id, hemisphere"
ORIGIN = "CASE WHEN origin_csv = '' THEN '(not recorded)' ELSE origin_csv END AS origin_csv"


def point_csv(t, rows, name):
    path = scratch_path(t.spark, name)
    rows.write.option("header", "true").csv(path)
    return path


def without_origin(rows):
    return rows.select("label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere")


FIFTH = "pmod(xxhash64(x, y, z, label), 5)"


def mixed_files(t, rows, folder, orders):
    """Files of different column orders in one folder; the last order also gets an extra column."""
    columns = rows.columns
    for k, order in enumerate(orders):
        own = rows.filter(f"{FIFTH} % {len(orders)} = {k}").select(*sorted(columns, key=order), *([F.lit("n").alias("note")] if k == len(orders) - 1 else []))
        own.coalesce(1).write.mode("append").option("header", "true").csv(folder)


ORDERS = (lambda c: 0, lambda c: c, lambda c: c[::-1])


@query("read_points_csv", "points", f"SELECT {POINT_COLS} FROM points")
def _(t):
    raw = t.points.select(
        F.col("label").alias("marker"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("id").alias("region"),
        F.col("hemisphere").alias("side"), F.col("region_name").alias("area"), F.col("acronym").alias("short"))
    path = scratch_path(t.spark, "points")
    mixed_files(t, raw, path, ORDERS)
    mapping = {"label": "marker", "x": "px", "y": "py", "z": "pz", "id": "region", "hemisphere": "side", "region_name": "area", "acronym": "short"}
    return SP.read_points_csv(t.spark, path, mapping).drop("origin_csv", "note")


@query("infer_points_format", "points", "SELECT 'standard,two-row' AS kind, 2 * count(*) AS n FROM points")
def _(t):
    path = point_csv(t, without_origin(t.points), "infer")
    two_row_files(t, t.points, path)
    return SP.read_points_csv(t.spark, path).agg(F.lit(SP.infer_points_format(t.spark, path)).alias("kind"), F.count("*").alias("n"))


HEADER = ["Marker,Experiment,,,,Channels,Atlas,,,Region,,,", "Marker,x,y,z,strength,Channel mono channel,x,y,z,name,acronym,id,hemisphere"]


def headed(batches):
    """Both header lines at the start of every part file."""
    import pandas as pd

    for number, batch in enumerate(batches):
        yield pd.concat([pd.DataFrame({"value": HEADER}), batch]) if number == 0 else batch


def two_row_files(t, rows, path):
    cells = ["label", "x", "y", "z", F.lit("1"), F.lit("m"), "x", "y", "z", "region_name", "acronym", "id", "hemisphere"]
    body = rows.select(F.concat_ws(",", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells]).alias("value"))
    body.mapInPandas(headed, "value string").write.mode("append").text(path)


@query("read_points_two_row", "points", f"SELECT {POINT_COLS}, x::VARCHAR AS experiment_x FROM points")
def _(t):
    path = scratch_path(t.spark, "two-row")
    two_row_files(t, t.points, path)
    return SP.read_points_csv(t.spark, path).select("label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere", "experiment_x")


@query("read_points_parquet", "points", f"SELECT {POINT_COLS}, origin_csv FROM points")
def _(t):
    path = scratch_path(t.spark, "points")
    t.points.write.parquet(path)
    return SP.read_points_parquet(t.spark, path)


@query("append_points", "points", f"""
SELECT {POINT_COLS}, {ORIGIN} FROM points UNION ALL SELECT {POINT_COLS}, '(not recorded)' FROM points""")
def _(t):
    path = scratch_path(t.spark, "points")
    rows = SP.validate_points(t.points.withColumn("origin_csv", origin_form("origin_csv")))
    rows.write.parquet(path)
    SP.append_points(t.spark, path, rows.withColumn("origin_csv", F.lit("")))
    return t.spark.read.parquet(path)


@query("convert_points_dir", "points", f"""
SELECT {POINT_COLS}, {ORIGIN}, FALSE AS two FROM points UNION ALL SELECT {POINT_COLS}, NULL, TRUE FROM points""")
def _(t):
    folder, out = scratch_path(t.spark, "csv"), scratch_path(t.spark, "points")
    rows = t.points.select("label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere", origin_form("origin_csv").alias("origin_csv"))
    mixed_files(t, rows, folder, ORDERS)
    two_row_files(t, t.points, folder)
    SP.convert_points_dir(t.spark, folder, out)
    two = F.col("strength").isNotNull()
    done = t.spark.read.parquet(out).withColumn("two", two).withColumn("origin_csv", F.when(~two, F.col("origin_csv")))
    return done.select("label", "x", "y", "z", "region_name", "acronym", "id", "hemisphere", "origin_csv", "two")


# --- morphology text and node tables

TEXT_COLS = "file_id, node_id, type, x, y, z, radius, parent_id"


def text_lines(t, damaged=True):
    """The node table as morphology text with comments and short lines; some files carry a broken field."""
    rows = SN.swc_lines(t.nodes)
    broken = damaged and F.col("file_id").rlike("[37]\\.swc$") & (F.col("node_id") == 2)
    value = F.when(broken, "2 axon 1 1 1 1 1") if damaged else F.lit(None).cast("string")
    lines = F.when(F.col("node_id") == 1, F.array(F.lit("# comment"), F.lit("1 2 3"), F.col("value")))
    rows = rows.withColumn("value", F.coalesce(value, F.col("value")))
    return rows.select("file_id", F.col("file_id").alias("path"), F.explode(F.coalesce(lines, F.array("value"))).alias("value"))


@query("ingest_swc", "nodes", f"SELECT {TEXT_COLS}, substr(file_id, 1, 6) AS neuron_id FROM nodes WHERE NOT regexp_matches(file_id, '[37]\\.swc$')")
def _(t):
    return SN.parse_swc(text_lines(t)).nodes.select("file_id", "node_id", "type", "x", "y", "z", "radius", "parent_id", "neuron_id")


@query("ingest_failures", "nodes", "SELECT DISTINCT file_id, 'field is not a number' AS reason FROM nodes WHERE regexp_matches(file_id, '[37]\\.swc$')")
def _(t):
    return SN.parse_swc(text_lines(t)).failures


@query("ingest_summary", "nodes", """
WITH f AS (SELECT file_id, regexp_matches(file_id, '[37]\\.swc$') AS bad, count(*) AS n, avg(z) FILTER (type = 1) AS z FROM nodes GROUP BY file_id)
SELECT count(*) AS discovered, count(*) FILTER (NOT bad) AS processed, count(*) FILTER (bad) AS failed,
count(*) FILTER (NOT bad AND abs(z - 150) >= 1 AND z > 150) AS flipped, count(*) FILTER (NOT bad AND abs(z - 150) >= 1 AND z < 150) AS already_target,
count(*) FILTER (NOT bad AND abs(z - 150) < 1) AS midline, sum(n) FILTER (NOT bad)::BIGINT AS rows_written, 0::BIGINT AS duplicate_names FROM f""")
def _(t):
    from ..operators.hemisphere import soma_sides

    found = SN.parse_swc(text_lines(t))
    return SN.ingest_summary(found, soma_sides(found.nodes, "z", 150.0, "left"))


@query("parse_filename", "nodes", """
WITH f AS (SELECT file_id, concat(substr(file_id, 2, 5), '_', substr(file_id, 2, 3), '_x.swc') AS plain, concat('H19.03.315.11.12.01.0', substr(file_id, 6, 1), '_', substr(file_id, 2, 5), '_m.swc') AS dotted FROM (SELECT DISTINCT file_id FROM nodes) n)
SELECT file_id, substr(plain, 7, 3) AS plain_subject, substr(plain, 1, 5) AS plain_neuron, substr(dotted, 1, 22) AS dotted_subject,
substr(dotted, 24, 5) AS dotted_neuron, substr(file_id, 1, 6) AS other FROM f""")
def _(t):
    files = t.nodes.select("file_id").distinct()
    part = lambda a, n: F.substring("file_id", a, n)
    plain = F.concat(part(2, 5), F.lit("_"), part(2, 3), F.lit("_x.swc"))
    dotted = F.concat(F.lit("H19.03.315.11.12.01.0"), part(6, 1), F.lit("_"), part(2, 5), F.lit("_m.swc"))
    return files.select(
        "file_id", subject_of(plain).alias("plain_subject"), neuron_of(plain).alias("plain_neuron"), subject_of(dotted).alias("dotted_subject"),
        neuron_of(dotted).alias("dotted_neuron"), neuron_of("file_id").alias("other"))


@query("write_nodes", "named", "SELECT file_id, node_id, type, x, y, z, radius, parent_id, region_id, region_name, region_acronym, subject, neuron_id FROM named")
def _(t):
    path = scratch_path(t.spark, "nodes")
    SN.write_nodes(t.named_nodes, path)
    return SN.scan_nodes(t.spark, path)


@query("append_nodes", "nodes", "SELECT file_id, node_id, x FROM nodes")
def _(t):
    # some neurons are in the table before; the whole table is appended, with other coordinates for the known ones
    path = scratch_path(t.spark, "nodes")
    SN.write_nodes(t.nodes.filter("file_id LIKE '%5.swc'"), path)
    SN.append_nodes(t.spark, path, t.nodes.withColumn("x", F.when(F.col("file_id").like("%5.swc"), -1.0).otherwise(F.col("x"))))
    return t.spark.read.parquet(path).select("file_id", "node_id", "x")


@query("write_swc", "nodes", f"SELECT {TEXT_COLS} FROM nodes")
def _(t):
    path = scratch_path(t.spark, "swc")
    SN.write_swc(t.nodes, path)
    return SN.ingest_swc(t.spark, path).nodes.select("file_id", "node_id", "type", "x", "y", "z", "radius", "parent_id")


@query("write_profile", "profile", """
SELECT file_id, region_id, laterality, compartment, round(cable_length_um, 6) AS cable_length_um, node_count, terminus_count FROM profile""")
def _(t):
    path = scratch_path(t.spark, "profile")
    write_profile(profile(t), path)
    return rounded(t.spark.read.parquet(path), "cable_length_um")


# --- exports

@query("write_clustered_nodes", "nodes lb", "SELECT n.file_id, node_id, x, b AS cluster_assignment FROM nodes n LEFT JOIN lb ON lb.file_id = n.file_id")
def _(t):
    path = scratch_path(t.spark, "clustered")
    SR.write_clustered_nodes(t.nodes.withColumn("cluster_assignment", F.lit(9)), run(t, "B"), path)
    return t.spark.read.parquet(path).select("file_id", "node_id", "x", "cluster_assignment")


@query("write_annotated_nodes", "nodes annotations la lb", """
SELECT n.file_id, node_id, s.label AS neuron_label, CASE WHEN tags <> '[]' THEN tags END AS neuron_tags_json, b AS cluster_assignment, a AS cluster_soma_1, b AS cluster_soma_2
FROM nodes n LEFT JOIN annotations s ON s.file_id = n.file_id LEFT JOIN la ON la.file_id = n.file_id LEFT JOIN lb ON lb.file_id = n.file_id""")
def _(t):
    path = scratch_path(t.spark, "annotated")
    SR.write_annotated_nodes(t.nodes, entries(t), path, stored(t), "B")
    return t.spark.read.parquet(path).select(
        "file_id", "node_id", "neuron_label", "neuron_tags_json", "cluster_assignment", "cluster_soma_1", "cluster_soma_2")


@query("read_annotations", "nodes annotations", """
SELECT n.file_id, n.subject, s.label, '' AS "group", CASE tags WHEN '[]' THEN '' WHEN '["a"]' THEN 'a' WHEN '["b"]' THEN 'b' ELSE 'a,b' END AS tags, '' AS notes,
NULL::INT AS cluster_id FROM (SELECT file_id, max(subject) AS subject FROM nodes GROUP BY file_id) n LEFT JOIN annotations s USING (file_id)""")
def _(t):
    rows = SR.read_annotations(SR.attach_annotations(t.nodes, entries(t)))
    return rows.withColumn("tags", F.array_join("tags", ","))


@query("write_cohort_nodes", "nodes lb", "SELECT n.file_id, node_id, x, b AS label FROM nodes n JOIN lb ON lb.file_id = n.file_id")
def _(t):
    path = scratch_path(t.spark, "cohort")
    rows = run(t, "B").withColumn("row_order", F.col("label"))
    SR.write_cohort_nodes(t.nodes, rows, path)
    return t.spark.read.parquet(path).select("file_id", "node_id", "x", "label")


@query("write_projected_csv", "final", """
SELECT file_id, node_id, x_flat, y_flat, valid, nullif(invalid_reason, '') AS invalid_reason, flatmap_lookup_mode FROM final""")
def _(t):
    path = scratch_path(t.spark, "projected")
    SR.write_projected_csv(projected(t), path)
    kinds = {"node_id": "int", "x_flat": "double", "y_flat": "double", "valid": "boolean"}
    rows = t.spark.read.option("header", "true").csv(path)
    return rows.select("file_id", *[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "invalid_reason", "flatmap_lookup_mode")


def search_result(t):
    reference = first_file(t)
    request = S.VoxelSearch((reference,), top_n=10)
    hits = settle(S.voxel_search(t.nodes, request, check=False))
    names = C.neuron_catalog(t.nodes)
    return names.filter(F.col("file_id") == reference), hits, S.search_context(request), names


def hits_sql():
    from .similarity import HITS
    return HITS.format(10).strip()


HEAD, TAIL = hits_sql().rsplit("\nSELECT CAST(row_number()", 1)
RESULT_ROWS = HEAD + ",\nhits AS (SELECT CAST(row_number()" + TAIL + ")\n"


@query("write_search_csv", "counts universe first_file", RESULT_ROWS + """
SELECT 2 AS format_version, 'reference' AS row_role, 0::BIGINT AS rank, (SELECT ref FROM first_file) AS file_id, NULL::DOUBLE AS pearson_distance
UNION ALL SELECT 2, 'search_result', rank::BIGINT, file_id, pearson_distance FROM hits""")
def _(t):
    references, hits, context, _ = search_result(t)
    return rounded(SR.search_rows(references, hits, context), "pearson_distance").select("format_version", "row_role", "rank", "file_id", "pearson_distance")


@query("read_search_csv", "counts universe first_file", RESULT_ROWS + """
SELECT 'reference' AS row_role, 0::BIGINT AS rank, (SELECT ref FROM first_file) AS file_id, NULL::DOUBLE AS pearson_distance, true AS available
UNION ALL SELECT 'search_result', rank::BIGINT, file_id, pearson_distance, true FROM hits""")
def _(t):
    references, hits, context, names = search_result(t)
    path = scratch_path(t.spark, "search")
    SR.write_search_csv(references, hits, context, path)
    rows = SR.read_search_csv(t.spark, path, names)
    return rounded(rows, "pearson_distance").select("row_role", "rank", "file_id", "pearson_distance", "available")


# --- streams

@query("stream_append_swc", "nodes", f"""
SELECT file_id, node_id, type, CASE WHEN file_id LIKE '%1.swc' THEN -1 ELSE x END AS x, y, z, radius, parent_id FROM nodes""")
def _(t):
    folder, table, state = (scratch_path(t.spark, n) for n in ("incoming", "nodes", "state"))
    # some neurons are in the table before, with other coordinates; the stream brings all of them and leaves those alone
    SN.write_nodes(t.nodes.filter("file_id LIKE '%1.swc'").withColumn("x", F.lit(-1.0)), table)
    SN.write_swc(t.nodes, folder)
    appends.stream_append_swc(t.spark, folder, table, state).awaitTermination()
    return t.spark.read.parquet(table).select("file_id", "node_id", "type", "x", "y", "z", "radius", "parent_id")


@query("stream_append_points", "points", f"""
SELECT {POINT_COLS}, NULL AS reason FROM points UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'id' FROM points WHERE label = 'error'""")
def _(t):
    folder, table, state = (scratch_path(t.spark, n) for n in ("incoming", "points", "state"))
    rows = without_origin(t.points).withColumn("id", F.col("id").cast("string"))
    bad = rows.filter("label = 'error'").withColumn("id", F.lit("7.5"))
    mixed_files(t, rows.unionByName(bad), folder, ORDERS)
    appends.stream_append_points(t.spark, folder, table, state).awaitTermination()
    good = appends.streamed_points(t.spark, table).select(*rows.columns, F.lit(None).cast("string").alias("reason"))
    rejected = t.spark.read.json(f"{table}_rejected").select("reason")
    return good.unionByName(rejected, allowMissingColumns=True)
