"""Slide directories, manifests, panel, region and stage files on generated fixtures."""

import gzip
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytomosaic.sources import manifest, slides, tables

GENES = [f"g{i:02d}" for i in range(12)]


def write_slide(root, name, genes, cells="parquet", ids="one", n=60, seed=0):
    rng = np.random.default_rng(seed)
    d = root / name
    m = d / "cell_feature_matrix"
    m.mkdir(parents=True)
    rows = [(f"id_{g}", g, "Gene Expression") for g in genes] + [("b1", "blank1", "Blank Codeword"), ("n1", "neg1", "Negative Control Probe")]
    with gzip.open(m / "features.tsv.gz", "wt") as fh:
        fh.writelines("\t".join(r) + "\n" for r in rows)
    with gzip.open(m / "barcodes.tsv.gz", "wt") as fh:
        fh.writelines(f"{i + 1}\n" for i in range(n))
    dense = rng.poisson(0.7, (len(rows), n))
    g, c = np.nonzero(dense)
    with gzip.open(m / "matrix.mtx.gz", "wt") as fh:
        fh.write("%%MatrixMarket matrix coordinate integer general\n%\n")
        fh.write(f"{len(rows)} {n} {len(g)}\n")
        fh.writelines(f"{i + 1} {j + 1} {dense[i, j]}\n" for i, j in zip(g, c))
    table = pd.DataFrame({"cell_id": [str(i + (1 if ids == "one" else 0)) for i in range(n)], "x_centroid": np.arange(n, dtype=float),
                          "Y_Centroid": np.arange(n) * 2.0, "cell_area": 30.0})
    if cells == "parquet":
        table.to_parquet(d / "cells.parquet")
    elif cells == "csv":
        table.to_csv(d / "cells.csv", index=False)
    (d / "experiment.json").write_text(json.dumps({"run_name": name, "panel": {"n": len(genes)}}))
    return str(d), dense, rows


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    specs = [("s1", "OLD", GENES, "parquet", "one"), ("s2", "OLD", GENES[:-1], "csv", "one"),
             ("s3", "NEW", GENES, "parquet", "zero"), ("s4", "NEW", [*GENES, "own"], "none", "one")]
    made = {s[0]: write_slide(root, s[0], s[2], s[3], s[4], seed=i) for i, s in enumerate(specs)}
    rows = [{"slide_id": s[0], "condition": s[1], "run_dir": made[s[0]][0]} for s in specs]
    return root, made, manifest.from_rows(spark, rows)


def test_read_study_matches_dense(spark, study):
    _, made, man = study
    cells, counts, features = slides.read_study(spark, man)
    assert cells.count() == 240
    got = {(r.slide_id, r.cell_id, r.gene): r["count"] for r in counts.collect()}
    want = {}
    for s, (_, dense, rows) in made.items():
        for i, j in zip(*np.nonzero(dense)):
            if rows[i][2] == "Gene Expression":
                want[(s, f"{s}__{j + 1}", rows[i][1])] = int(dense[i, j])
    assert got == want
    assert features.filter("feature_type <> 'Gene Expression'").count() == 8


def test_cell_alignment_strategies(spark, study):
    _, _, man = study
    aligned, chosen = slides.align_cells(slides.read_barcodes(spark, man), slides.read_cell_tables(spark, man))
    assert {r.slide_id: r.strategy for r in chosen.collect()} == {"s1": "id", "s2": "id", "s3": "zero_based"}
    rows = {(r.slide_id, r.barcode): (r.x, r.y) for r in aligned.collect()}
    assert rows[("s1", "5")] == (4.0, 8.0) and rows[("s2", "5")] == (4.0, 8.0) and rows[("s3", "5")] == (4.0, 8.0)
    assert rows[("s4", "5")] == (None, None)


def test_shape_check(spark, study):
    _, _, man = study
    _, sizes = slides.read_matrix(spark, man)
    with pytest.raises(ValueError, match="matrix shape"):
        slides.check_shapes(sizes.withColumn("n_cells", F.col("n_cells") + 1), slides.read_features(spark, man), slides.read_barcodes(spark, man))


def test_run_metadata(spark, study):
    _, _, man = study
    rows = {r.slide_id: r.entries for r in slides.read_run_metadata(spark, man, "experiment.json").collect()}
    assert rows["s2"]["run_name"] == "s2" and len(rows) == 4


def test_manifest_csv_header_sniff(spark, study, tmp_path):
    root, made, _ = study
    plain, headed = tmp_path / "plain.csv", tmp_path / "headed.csv"
    plain.write_text(f"a,OLD,{made['s1'][0]}\nb,NEW,{made['s2'][0]}\n")
    headed.write_text(f"Slide,Group,Folder,Rep\na,OLD,{made['s1'][0]},r1\nb,NEW,{made['s2'][0]},\n")
    assert sorted(r.replicate_id for r in manifest.from_csv(spark, str(plain)).collect()) == ["a", "b"]
    assert sorted(r.replicate_id for r in manifest.from_csv(spark, str(headed)).collect()) == ["b", "r1"]
    with pytest.raises(ValueError, match="expected 4"):
        manifest.check_replicates(manifest.from_csv(spark, str(plain)), {"OLD": 4})


def test_unique_names(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "a"), ("s", 3, "a")], "slide_id string, i int, gene string")
    assert [r.gene for r in slides.unique_names(df, "gene", ["slide_id"], "i").orderBy("i").collect()] == ["a", "b", "a-1", "a-2"]


def test_panel_source(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("Genes,Ensembl_ID,Num_Probesets,Codewords,Annotation\nA,E1,8,1,x\nB,E2,6,1,y\nA,E3,4,1,z\n")
    assert {r.gene: (r.ensembl_id, r.n_probesets) for r in tables.read_panel(spark, str(path)).collect()} == {"A": ("E1", 8), "B": ("E2", 6)}
    path.write_text("Genes,Annotation\nA,x\n")
    with pytest.raises(ValueError, match="Ensembl_ID"):
        tables.read_panel(spark, str(path))


def test_roi_round_trip_and_import(spark, tmp_path):
    (tmp_path / "s_1_roi.json").write_text(json.dumps({
        "slide_id": "s 1", "roi_name": "arc", "vertices": [[0, 0], [4, 0], [4, 4]], "n_cells_selected": 7, "created_at": "2024-01-01", "method": "gui"}, indent=1))
    (tmp_path / "bad_roi.json").write_text(json.dumps({"slide_id": "bad", "roi_name": "x", "vertices": [[0, 0], [1, 1]]}))
    rois = tables.read_rois(spark, str(tmp_path))
    assert [(r.slide_id, r.n_vertices, r.n_cells) for r in tables.list_rois(rois).collect()] == [("s 1", 3, 7)]
    out = str(tmp_path / "stored")
    tables.write_rois(rois, out)
    back = tables.read_stored_rois(spark, out).first()
    assert [(v.x, v.y) for v in back.vertices] == [(0, 0), (4, 0), (4, 4)] and back.bbox.x_max == 4
    text = json.dumps({"a": {"vertices": [[0, 0], [1, 0], [1, 1]], "roi_name": "r"}, "b": {"vertices": [[0, 0]]}, "c": {"vertices": [[0, 0], [1], [2, 2]]}})
    good, bad = tables.import_rois(spark.createDataFrame([(text,)], "json string"))
    assert [r.slide_id for r in good.collect()] == ["a"] and sorted(r.slide_id for r in bad.collect()) == ["b", "c"]
    again, _ = tables.import_rois(tables.export_rois(good))
    assert again.first().vertices == good.first().vertices


def test_profile_source(spark, tmp_path):
    path = tmp_path / "profile.csv"
    path.write_text("gene,T cell,B cell\na,1.5,0\nb,0,2\n")
    rows = {(r.gene, r.cell_type): r.value for r in tables.read_profile(spark, str(path)).collect()}
    assert rows == {("a", "T cell"): 1.5, ("a", "B cell"): 0.0, ("b", "T cell"): 0.0, ("b", "B cell"): 2.0}
    assert tables.shared_genes(tables.read_profile(spark, str(path)), spark.createDataFrame([("a",)], "gene string")).first().too_few


def test_stage_rebuilds_empty_and_lands(spark, study, tmp_path):
    _, _, man = study
    root = str(tmp_path / "landed")
    cells, counts, _ = tables.land_study(spark, man, root)
    assert cells.count() == 240 and "slide_id" in counts.columns
    again = tables.stage(spark, f"{root}/cells", lambda: pytest.fail("cache must be used"))
    assert again.count() == 240
    with pytest.raises(ValueError, match="no rows"):
        tables.stage(spark, str(tmp_path / "empty"), lambda: cells.filter("false"))
    assert tables.write_results({"per_slide": cells.groupBy("slide_id").count()}, str(tmp_path / "out")) == {"per_slide": 4}
    assert tables.run_summary({"a": cells, "b": counts}).filter("result = 'a'").first().n_rows == 240


def test_two_condition_runs(spark, study):
    _, made, _ = study
    cells, counts, _ = slides.two_condition_runs(spark, made["s1"][0], made["s3"][0], "A", "B")
    assert {r.condition for r in cells.select("condition").distinct().collect()} == {"A", "B"}
    assert slides.prefix_cells(cells, "x").first().cell_id.startswith("x__")
    assert slides.union_studies(cells, cells.drop("x")).count() == 240


def test_csv_row_numbers_survive_file_splits(spark, tmp_path):
    """A table without id column matches by row number, however many splits its file has."""
    n = 1000
    d = tmp_path / "split"
    (d / "cell_feature_matrix").mkdir(parents=True)
    pd.DataFrame({"x": np.arange(n, dtype=float), "y": np.arange(n) * 2.0, "pad": ["p" * 40] * n}).to_csv(d / "cells.csv", index=False)
    with gzip.open(d / "cell_feature_matrix" / "barcodes.tsv.gz", "wt") as fh:
        fh.writelines(f"{i + 1}\n" for i in range(n))
    man = manifest.from_rows(spark, [{"slide_id": "S", "condition": "c", "run_dir": str(d)}])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        table = slides.read_cell_tables(spark, man)
        assert table.select(F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first() == (0, n - 1, n)
        aligned, used = slides.align_cells(slides.read_barcodes(spark, man), table)
        assert aligned.filter("x IS NULL OR x <> cell_idx").count() == 0
        assert used.first().asDict() == {"slide_id": "S", "strategy": "zero_based", "n_matched": n, "matched_share": 1.0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_poor_alignment_is_an_error_below_the_callers_share(spark):
    barcodes = spark.createDataFrame([("S", i, str(i)) for i in range(10)], "slide_id string, cell_idx long, barcode string")
    table = spark.createDataFrame([("S", str(i), i, 1.0) for i in range(4)], "slide_id string, cell_key string, row_index long, x double")
    _, used = slides.align_cells(barcodes, table)
    assert used.first().matched_share == 0.4
    with pytest.raises(ValueError, match="4 of 10"):
        slides.align_cells(barcodes, table, min_share=0.5)


def test_panel_stage_lands_harmonised_counts(spark, tmp_path):
    from cytomosaic.config import StudyConfig

    man = manifest.from_rows(spark, [{"slide_id": s, "condition": c, "run_dir": "/x"} for s, c in (("S1", "A"), ("S2", "B"))])
    features = spark.createDataFrame([("S1", "g1"), ("S2", "g1"), ("S1", "own")], "slide_id string, gene string")
    panel = spark.createDataFrame([("g1", "E1", 1, "x")], "gene string, ensembl_id string, n_probesets int, annotation string")
    counts = spark.createDataFrame([("S1", "c1", "g1", 3), ("S1", "c1", "own", 5)], "slide_id string, cell_id string, gene string, count int")
    kept, meta, checked = tables.land_panel(spark, man, counts, features, panel, str(tmp_path / "a"), StudyConfig(min_slides=2), {"A": 1, "B": 1})
    assert [r.gene for r in kept.collect()] == ["g1"] and meta.count() == 2 and checked.filter("base_complete").count() == 2
    kept, meta, _ = tables.land_panel(spark, man, counts, features, panel, str(tmp_path / "b"), StudyConfig(harmonise_mode="union"))
    assert {r.gene for r in kept.collect()} == {"g1", "own"} and [r.slide_id for r in meta.filter("zero_filled").collect()] == ["S2"]
    with pytest.raises(ValueError, match="expected 2"):
        tables.land_panel(spark, man, counts, features, panel, str(tmp_path / "c"), StudyConfig(), {"A": 2})
