"""Ligand-receptor operators over one ligand and two receptors: status, ratio index, niche, proximity, regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.tails import chi2_sf
from ..schemas import CELL_KEY
from .matrix import distinct_values, group_gene_stats
from .neighbors import nearest_of_class, spatial_knn


@dataclass(frozen=True)
class Axis:
    """Genes of one signalling axis; the defaults are fixed values of the study being reproduced."""

    ligand: str = "Gal"
    receptor1: str = "Galr1"
    receptor2: str = "Galr3"

    @property
    def genes(self) -> list[str]:
        return [self.ligand, self.receptor1, self.receptor2]


def gene_presence(expr: DataFrame, axis: Axis = Axis()) -> DataFrame:
    wanted = F.array(*[F.lit(g) for g in axis.genes])
    found = distinct_values(expr, "gene")
    return expr.sparkSession.range(1).select(F.explode(wanted).alias("gene")).withColumn(
        "present", F.array_contains(found, F.col("gene")))


def axis_table(expr: DataFrame, cells: DataFrame, axis: Axis = Axis(), threshold: float = 0.0) -> DataFrame:
    """Per cell: the three values (missing = 0), positivity flags, ratio index L / (R1 + R2 + 1) and status."""
    pick = lambda g: F.coalesce(F.max(F.when(F.col("gene") == g, F.col("lognorm"))), F.lit(0.0))
    wide = expr.filter(F.col("gene").isin(axis.genes)).groupBy(*CELL_KEY).agg(
        pick(axis.ligand).alias("ligand"), pick(axis.receptor1).alias("r1"), pick(axis.receptor2).alias("r2"))
    full = cells.join(wide, CELL_KEY, "left").fillna(0.0, subset=["ligand", "r1", "r2"])
    flags = (full.withColumn("lig_pos", F.col("ligand") > threshold).withColumn("r1_pos", F.col("r1") > threshold)
             .withColumn("r2_pos", F.col("r2") > threshold)
             .withColumn("index", F.col("ligand") / (F.col("r1") + F.col("r2") + 1.0)))
    l, a, b = F.col("lig_pos"), F.col("r1_pos"), F.col("r2_pos")
    n, p, q = axis.ligand, axis.receptor1, axis.receptor2
    status = (F.when(l & a, f"{n}+{p}+").when(l & b, f"{n}+{q}+").when(l, f"{n}+only").when(a & b, f"{p}+{q}+")
              .when(a, f"{p}+only").when(b, f"{q}+only").otherwise("Negative"))
    return flags.withColumn("status", status)


def coexpression_proportions(table: DataFrame, condition: str = "condition") -> DataFrame:
    l, a, b = F.col("lig_pos"), F.col("r1_pos"), F.col("r2_pos")
    counts = table.groupBy(condition).agg(
        F.count_if(l).alias("n_ligand_pos"), F.count_if(l & a).alias("n_ligand_r1"), F.count_if(l & b).alias("n_ligand_r2"),
        F.count_if(l & a & b).alias("n_both_receptors"), F.count_if(l & (a | b)).alias("n_any_receptor"))
    pct = lambda c, out: (100.0 * F.col(c) / F.greatest(F.col("n_ligand_pos"), F.lit(1))).alias(out)
    return counts.select("*", pct("n_ligand_r1", "pct_r1"), pct("n_ligand_r2", "pct_r2"), pct("n_any_receptor", "pct_any_receptor"))


def niche_scores(points: DataFrame, table: DataFrame, k: int = 15, pool_slides: bool = False) -> DataFrame:
    """Ligand-positive cells: share of the k nearest cells that carry a receptor; NULL for the others."""
    asking = points.join(table.filter("lig_pos").select(*CELL_KEY), CELL_KEY, "left_semi")
    # targets are all cells; the self match is excluded by id
    near = spatial_knn(asking, k, targets=points, pool_slides=pool_slides)
    carries = table.select(F.col("cell_id").alias("dst"), (F.col("r1_pos") | F.col("r2_pos")).cast("double").alias("f"))
    score = near.join(carries, "dst").groupBy(F.col("src").alias("cell_id")).agg(F.avg("f").alias("niche_score"))
    return points.select(*CELL_KEY).join(score, "cell_id", "left")


def receptor_distances(points: DataFrame, table: DataFrame, pool_slides: bool = False) -> DataFrame:
    """Ligand-positive cells: distance to the nearest carrier of each receptor (0 when the cell carries it itself)."""
    keyed = points.select(*CELL_KEY, "x", "y").join(table.select(*CELL_KEY, "condition", "lig_pos", "r1_pos", "r2_pos"), CELL_KEY)
    asking = keyed.filter("lig_pos").select(*CELL_KEY, "condition", "x", "y")
    out = asking
    for flag, name in (("r1_pos", "dist_r1"), ("r2_pos", "dist_r2")):
        hit = nearest_of_class(asking, keyed.filter(flag), pool_slides).select(*CELL_KEY, F.col("dist").alias(name))
        out = out.join(hit, CELL_KEY, "left")
    return out


def distance_summary(distances: DataFrame) -> DataFrame:
    long = distances.select("condition", F.expr("stack(2, 'r1', dist_r1, 'r2', dist_r2) AS (receptor, dist)")).filter("dist IS NOT NULL")
    by = ["condition", "receptor"]
    means = long.groupBy(*by).agg(F.avg("dist").alias("mean"))
    q = exact_quantiles(long, by, "dist", [0.25, 0.5, 0.75])
    return q.join(means, by).select(*by, "n", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def regional_summary(expr: DataFrame, cells: DataFrame, table: DataFrame, region: str, axis: Axis = Axis(),
                     fallback: str = "cell_type") -> DataFrame:
    """Per region, condition and axis gene: mean, percent expressing, cells and mean ratio index."""
    key = region if region in cells.columns else fallback
    groups = [key, "condition"]
    genes = F.array(*[F.lit(g) for g in axis.genes])
    st = group_gene_stats(expr.filter(F.col("gene").isin(axis.genes)), cells, groups, "lognorm", genes)
    index = table.groupBy(*groups).agg(F.avg("index").alias("index_mean"))
    return st.join(index, groups).select(
        F.col(key).alias("region"), "condition", "gene", F.col("mean").alias("mean_expr"),
        (100.0 * F.col("pct")).alias("pct_expressing"), "n_cells", "index_mean")


def receptor_chi_squared(table: DataFrame, reference: str, test: str, receptor_flag: str) -> DataFrame:
    """2 x 2 test of receptor carriage among ligand-positive cells with Yates correction; a cell below 1 gives p = 1."""
    hit = F.col("lig_pos") & F.col(receptor_flag)
    miss = F.col("lig_pos") & ~F.col(receptor_flag)
    at = lambda who, rule: F.count_if((F.col("condition") == who) & rule).cast("double")
    counts = table.agg(at(reference, hit).alias("a"), at(reference, miss).alias("b"), at(test, hit).alias("c"), at(test, miss).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    num = F.greatest(F.abs(a * d - b * c) - n / 2.0, F.lit(0.0))
    bottom = (a + b) * (c + d) * (a + c) * (b + d)
    ok = F.least(a, b, c, d) >= 1.0
    scored = counts.withColumn("chi2", F.when(ok, n * num * num / bottom))
    return scored.withColumn("pval", F.when(ok, chi2_sf(F.col("chi2"), F.lit(1.0))).otherwise(F.lit(1.0)))


def contingency_chi_squared(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Pearson chi-squared of a long contingency table (Yates when 2 x 2); any cell below 1 gives NULL and p = 1.

    Built for small condition x status tables: one row per combination that occurs.
    """
    rows = counts.groupBy(row).agg(F.sum(n).alias("_r"))
    cols = counts.groupBy(column).agg(F.sum(n).alias("_c"))
    names = distinct_values(counts, column)
    grid = rows.withColumn(column, F.explode(names)).join(cols, column).join(counts.select(row, column, n), [row, column], "left").fillna(0, subset=[n])
    total = counts.select(F.sum(n).cast("double")).scalar()
    k = rows.select(F.count(F.lit(1))).scalar()
    m = cols.select(F.count(F.lit(1))).scalar()
    e = F.col("_r") * F.col("_c") / total
    diff = F.abs(F.col(n) - F.col("e"))
    shrunk = F.when(F.col("df") == 1, F.greatest(diff - 0.5, F.lit(0.0))).otherwise(diff)
    body = grid.withColumn("e", e).withColumn("df", (k - 1) * (m - 1)).agg(
        F.sum(shrunk * shrunk / F.col("e")).alias("chi2"), F.max("df").alias("df"), F.min(n).alias("_least"))
    ok = F.col("_least") >= 1
    return body.select(F.when(ok, F.col("chi2")).alias("chi2"), F.col("df").cast("double").alias("df")).withColumn(
        "pval", F.coalesce(chi2_sf(F.col("chi2"), F.col("df")), F.lit(1.0)))
