"""The registry agrees with its SQL on the smallest tables, and every SQL has a plan."""

import os

import pytest
from compare import compare, connect

SMOKE = "/root/testdata/sf0.001"
CHOSEN = ["qc_removal_report", "normalise_lognorm", "group_mean_pct", "dge_wilcoxon", "markers_vs_rest", "panel_gene_meta", "roi_yield", "spatial_knn",
          "gene_set_scores", "composition_clr_test", "box_summary"]


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_plan(registry):
    plans, oracle = registry
    assert set(oracle) <= set(plans) and len(plans) > 130


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="sample tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_plan_matches_sql(spark, registry, name):
    plans, oracle = registry
    message, failed = compare(spark, connect(SMOKE), plans[name], oracle[name], SMOKE)
    assert not failed, message
