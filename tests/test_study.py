"""The two-condition study: the panel stage, and settings that must show in the result."""

from dataclasses import replace

import numpy as np
import pytest

from cytomosaic.config import StudyConfig
from cytomosaic.operators import dge, normalize, panel
from cytomosaic.plans import pipelines


@pytest.fixture(scope="module")
def study(spark):
    """4 slides (2 + 2) of 30 cells x 8 genes; g7 is missing on one slide, own is on one slide only."""
    rng = np.random.default_rng(4)
    slides = [("S0", "A"), ("S1", "A"), ("S2", "B"), ("S3", "B")]
    genes = [f"g{i}" for i in range(8)]
    cells, counts, features = [], [], []
    for s, (slide, condition) in enumerate(slides):
        on = [g for g in genes if not (g == "g7" and slide == "S1")] + (["own"] if slide == "S0" else [])
        features += [(slide, g) for g in on]
        for c in range(30):
            cell = f"{slide}_{c}"
            cells.append((slide, cell, condition, slide, "T1" if c % 2 else "T2", float(c % 6), float(c // 6) + 10 * s))
            for g in on:
                n = int(rng.poisson(3 + (4 if g == "g1" and condition == "B" else 0)))
                if n:
                    counts.append((slide, cell, g, n))
    frame = spark.createDataFrame
    return {
        "cells": frame(cells, "slide_id string, cell_id string, condition string, replicate_id string, cell_type string, x double, y double"),
        "counts": frame(counts, "slide_id string, cell_id string, gene string, count int"), "features": frame(features, "slide_id string, gene string"),
        "panel": frame([(g, f"E{g}", 1, "x") for g in genes], "gene string, ensembl_id string, n_probesets int, annotation string"),
        "slides": frame(slides, "slide_id string, condition string")}


BASE = StudyConfig(reference_condition="A", test_condition="B", dge_method="stringent_wilcoxon", min_consistent_replicates=1, log2fc_threshold=0.1, pval_threshold=0.5,
                   dge_min_cells=3, min_pct=0.0, min_mean=0.0)


def tables(study, config, scope=True):
    counts, meta = panel.harmonise(study["counts"], study["features"], study["panel"], study["slides"], config.harmonise_mode, config.min_slides)
    expr = normalize.lognorm(counts, config.target_sum)
    return pipelines.study_dge(expr, study["cells"], counts, config, meta if scope else None), counts


def genes(df):
    return {r.gene for r in df.select("gene").distinct().collect()}


def test_harmonise_mode_and_min_slides_choose_the_genes(study):
    sets = {}
    for mode, least in (("intersection", 2), ("partial_union", 2), ("partial_union", 1), ("union", 2)):
        sets[mode, least] = genes(tables(study, replace(BASE, harmonise_mode=mode, min_slides=least))[1])
    assert sets["intersection", 2] == {f"g{i}" for i in range(7)}
    assert sets["partial_union", 2] == {f"g{i}" for i in range(8)}
    assert sets["partial_union", 1] == sets["union", 2] == {f"g{i}" for i in range(8)} | {"own"}


def test_structural_zeros_leave_the_test(study):
    config = replace(BASE, dge_method="wilcoxon", harmonise_mode="union")
    assert genes(tables(study, config)[0]["dge"]) == {f"g{i}" for i in range(7)}
    assert "g7" in genes(tables(study, config, scope=False)[0]["dge"])
    first = tables(study, replace(config, zero_fill_scope="first_slide"))[0]["dge"]
    assert genes(first) == {f"g{i}" for i in range(8)} | {"own"}


def test_dge_settings_show_in_the_result(study):
    rows = lambda config, name="dge": {tuple(r) for r in tables(study, config)[0][name].select("gene").collect()}
    base = rows(BASE)
    assert ("g1",) in base
    assert rows(replace(BASE, min_mean=99.0)) == set() and rows(replace(BASE, min_pct=1.1)) == set()
    assert rows(replace(BASE, log2fc_threshold=50.0)) == set()
    assert tables(study, replace(BASE, dge_min_cells=1000))[0]["cluster_dge"].count() == 0
    assert tables(study, BASE)[0]["cluster_dge"].count() > 0
    top = tables(study, replace(BASE, n_top_dge_genes=1))[0]
    assert top["cluster_dge_top"].groupBy("cell_type", "direction").count().agg({"count": "max"}).first()[0] == 1


def test_spatial_settings_show_in_the_result(study):
    expr = normalize.lognorm(study["counts"], 100.0)
    few = replace(BASE, moran_neighbors=2, n_permutations=4, n_spatial_neighbors=3, representative_slides={"A": "S1", "B": "S3"})
    out = pipelines.study_spatial(study["cells"], expr, few, ["g0", "g1"])
    wide = pipelines.study_spatial(study["cells"], expr, replace(few, moran_neighbors=8, n_permutations=9), ["g0", "g1"])
    z = lambda o, name: {r.gene: r.z_score for r in o[name].collect()}
    assert z(out, "moran") != z(wide, "moran")
    p = lambda o: {round(r.p_value, 6) for r in o["enrichment"].collect()}
    assert all(abs(x * 5 - round(x * 5)) < 1e-4 for x in p(out)) and p(out) != p(wide)
    assert {r.slide_id for r in out["representative_map"].select("slide_id").distinct().collect()} == {"S1", "S3"}


def test_default_marker_sets_are_used(spark):
    assert pipelines.study_signatures(spark).filter("gene = 'Agrp'").count() == 1
    assert dge.pick_conditions(spark.createDataFrame([("b",), ("a",), ("a",)], "condition string")) == ("a", "b")


def test_staged_quality_control_does_not_derive_the_counts_again(spark):
    from cytomosaic.operators import qc

    cells = spark.createDataFrame([("s", str(i)) for i in range(6)], "slide_id string, cell_id string")
    derived = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    rows = [("s", str(i), f"g{j}", 5) for i in range(6) for j in range(i)]
    kind = "slide_id string, cell_id string, gene string, count int"
    counts = spark.createDataFrame(rows, kind).mapInArrow(seen, kind)
    limits = {"min_counts": 10, "min_genes": 2}
    staged = qc.run_qc(cells, counts, 3, stage=True, **limits)[:2]
    before = derived.value
    got = [sorted(map(tuple, t.collect())) for t in staged]
    assert before > 0 and derived.value == before
    assert got == [sorted(map(tuple, t.collect())) for t in qc.run_qc(cells, counts, 3, **limits)[:2]]
    assert [r[1] for r in got[0]] == ["2", "3", "4", "5"] and {r[0] for r in got[1]} == {"g0", "g1", "g2"}
