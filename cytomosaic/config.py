"""Study parameters. The defaults below are fixed values of the analysis being reproduced."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StudyConfig:
    reference_condition: str = "Control"
    test_condition: str = "Treatment"
    # quality control
    min_counts: int = 10
    max_counts: int = 2000
    min_genes: int = 10
    max_genes: int = 300
    min_cells_per_gene: int = 5
    filter_control_probes: bool = True
    filter_control_codewords: bool = True
    min_cell_area: float = 20.0
    # normalisation
    target_sum: float = 100.0
    n_top_genes: int = 0
    normalize_by_cell_area: bool = False
    area_stage: str = "before_total"
    # panel
    harmonise_mode: str = "partial_union"
    min_slides: int = 2
    zero_fill_scope: str = "any_slide"
    # embedding and clustering
    n_pcs: int = 30
    batch_key: str = "slide_id"
    harmony_max_iter: int = 30
    n_neighbors: int = 12
    random_state: int = 42
    resolution: float = 0.6
    # differential expression
    dge_method: str = "stringent_wilcoxon"
    dge_min_cells: int = 5
    log2fc_threshold: float = 1.0
    pval_threshold: float = 0.01
    n_top_dge_genes: int = 25
    min_consistent_replicates: int = 3
    min_pct: float = 0.10
    min_mean: float = 0.1
    # spatial domains
    run_spatial_domains: bool = False
    lambda_spatial: float = 0.3
    domain_resolution: float = 0.5
    n_spatial_neighbors: int = 15
    domain_min_cells: int = 30
    # spatial statistics
    moran_neighbors: int = 6
    n_permutations: int = 500
    pool_slides: bool = False
    representative_slides: dict = field(default_factory=dict)

    def __post_init__(self):
        checks = {
            "min_counts": 0 <= self.min_counts <= self.max_counts,
            "min_genes": 0 <= self.min_genes <= self.max_genes,
            "target_sum": self.target_sum > 0,
            "lambda_spatial": 0.0 <= self.lambda_spatial <= 1.0,
            "harmonise_mode": self.harmonise_mode in ("intersection", "partial_union", "union"),
            "area_stage": self.area_stage in ("before_total", "after_total"),
            "zero_fill_scope": self.zero_fill_scope in ("any_slide", "first_slide"),
        }
        bad = [name for name, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
