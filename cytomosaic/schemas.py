"""Explicit schemas of the study tables (counts hold non-zero entries only; a missing row means 0)."""

from __future__ import annotations

CELL_KEY = ["slide_id", "cell_id"]

SLIDES = "slide_id STRING, condition STRING, replicate_id STRING, run_dir STRING"
FEATURES = "slide_id STRING, feature_idx BIGINT, gene_id STRING, gene STRING, feature_type STRING"
CELLS = (
    "slide_id STRING, cell_id STRING, condition STRING, replicate_id STRING, x DOUBLE, y DOUBLE, "
    "cell_area DOUBLE, control_probe_counts INT, control_codeword_counts INT"
)
COUNTS = "slide_id STRING, cell_id STRING, gene STRING, count INT"
ROIS = "slide_id STRING, roi_name STRING, vertices ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
EMBEDDING = "slide_id STRING, cell_id STRING, vec ARRAY<DOUBLE>"
SIGNATURES = "set_name STRING, label STRING, gene STRING, position INT"
PANEL = "gene STRING, ensembl_id STRING, n_probesets INT, annotation STRING"
