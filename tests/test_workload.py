"""Every registered query with a SQL twin returns the twin's rows on the smallest tables."""

import pytest
from oracle import compare, connect

from arborlake.workload import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) == ""


SALTED = [
    "voxel_mask_filter", "soma_exclusion_rules", "exclude_near_soma", "annotate_regions", "project_nodes", "augment_v3",
    "build_profile", "voxel_search_ccf", "region_report", "points_selection", "soma_dbscan",
]


@pytest.mark.parametrize("name", SALTED)
def test_twin_beyond_the_broadcast_bound(spark, con, no_broadcast, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) == ""


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
