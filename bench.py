"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The node table is written once as Parquet, as users have it, and every query is timed from that table to the last
row of its result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from arborlake.bridge import Tables  # noqa: E402
from arborlake.operators import catalog, flatmap, hemisphere, occupancy, pearson, profile, regions, topology, volumes  # noqa: E402
from arborlake.plans import region_index as ri, region_query as rq, report, search  # noqa: E402
from arborlake.plans.mask_query import neurons_in_masks  # noqa: E402
from arborlake.session import session, settle  # noqa: E402
from arborlake.workload.anatomy import FLAT, TREE  # noqa: E402
from arborlake.workload.similarity import projection  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def short_edges(nodes):
    """The same trees drawn so small that most edges stay inside one voxel, as in real reconstructions."""
    return nodes.withColumns({c: F.lit(mid) + (F.col(c) - F.lit(mid)) * 0.05 for c, mid in (("x", 200.0), ("y", 125.0), ("z", 150.0))})


def cases(t: Tables, built, short, index) -> dict:
    closure = settle(regions.structures_closure(t.structures))
    cohort = settle(t.assignments.filter("assignment_id = 'B'").select("file_id"))
    first = t.nodes.agg({"file_id": "min"}).first()[0]
    grid = flatmap.grid_for(t.nodes, "shaped", y_bins=64, depth_bin_um=50.0)
    return {
        "neuron_catalog": lambda: catalog.neuron_catalog(t.nodes),
        "unique_regions": lambda: catalog.unique_regions(t.named_nodes),
        "neurons_in_mask": lambda: neurons_in_masks(t.nodes, t.grid, [t.mask], node_types=[2, 3]),
        "heatmap_counts": lambda: volumes.heatmap_counts(t.nodes, t.grid),
        "termini": lambda: topology.termini(t.nodes),
        "edges": lambda: topology.edges(t.nodes),
        "annotate_regions": lambda: regions.annotate_regions(t.nodes, t.annotation, t.structures, t.grid),
        "align_hemisphere": lambda: hemisphere.align_hemisphere(t.nodes, "left", 150.0)[0],
        "voxel_counts": lambda: volumes.voxel_counts(t.nodes, 25.0),
        "voxel_search_ccf": lambda: search.voxel_search(t.nodes, search.VoxelSearch((first,), top_n=10)),
        "ccf_pearson": lambda: pearson.ccf_pearson(volumes.voxel_counts(t.nodes, 25.0)),
        "flatmap_heatmap": lambda: flatmap.flatmap_heatmap(t.nodes, grid, "file"),
        "project_nodes": lambda: flatmap.project_nodes(t.nodes, t.lookup, projection(t), mirror_fallback=True),
        "occupancy_labels": lambda: occupancy.region_labels_flat(occupancy.occupancy(t.annotation, t.lookup, t.grid, FLAT), FLAT),
        "split_edges": lambda: profile.split_edges(topology.edges(t.nodes), t.grid),
        "validate_trees": lambda: topology.validate_trees(t.nodes, t.structures),
        "build_profile": lambda: profile.build_profile(t.nodes, t.annotation, t.structures, t.grid, validate=False),
        "build_profile_short_validated": lambda: profile.build_profile(short, t.annotation, t.structures, t.grid),
        "region_query": lambda: rq.matching_files(built, closure, TREE),
        "region_query_indexed": lambda: ri.indexed_files(index, TREE),
        "region_report": lambda: report.region_report(built, closure, t.structures, cohort, split=True),
        "regional_distances": lambda: report.regional_distances(report.regional_features(built, closure, cohort, "cable", "split")),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    begin = time.perf_counter()
    for name in ("nodes", "annotation", "lookup", "mask"):
        t.__dict__[name] = settle(getattr(t, name))
    built = settle(profile.build_profile(t.nodes, t.annotation, t.structures, t.grid, validate=False))
    short = settle(short_edges(t.nodes))
    index = ri.build_index(built, regions.structures_closure(t.structures))
    prepare = time.perf_counter() - begin
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    timed = {}
    for name, build in cases(t, built, short, index).items():
        if only and name not in only:
            continue
        begin = time.perf_counter()
        run(build())
        timed[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "sf": sf_dir.rsplit("sf", 1)[-1],
        "prepare_seconds": round(prepare, 3), "nodes": t.nodes.count(),
    }))


if __name__ == "__main__":
    main()
