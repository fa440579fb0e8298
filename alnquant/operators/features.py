"""Roll-up of counts to features and categories, scaling and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scaling
from ..functions import sums

PAIR = ("uniq", "combined")


def _sum_pair(exact: bool, prefix: str = "") -> list[Column]:
    out = []
    for p in PAIR:
        out.append(sums.total(F.col(f"{p}_raw"), exact).alias(f"{prefix}{p}_raw"))
        out.append(sums.total(F.col(f"{p}_lnorm"), exact, norm=True).alias(f"{prefix}{p}_lnorm"))
    return out


def factor(raw: str, norm: str) -> Column:
    """Ratio of summed raw and length-normalised counts; 0 where nothing was counted."""
    return F.coalesce(F.try_divide(F.col(raw), F.col(norm)), F.lit(0.0))


def annotated(counts: DataFrame, annotations: DataFrame, on: list[str]) -> DataFrame:
    """Counts of the regions or references that have any annotation, each once."""
    return counts.join(annotations.select(*on).distinct().hint("merge"), on, "left_semi")


def annotate(counts: DataFrame, annotations: DataFrame, on: list[str]) -> DataFrame:
    """Counts of each region or reference beside each category that it has, and the features in it.  The counts are
    aggregated before this join, so it carries one row for each region, however deep the sequencing.  Annotations grow with
    the references and unfold from small files, so they are never broadcast, whatever size the optimizer expects."""
    return counts.join(annotations.hint("merge"), on)


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Rows with the columns of a frame of one row.  Nothing comes to the driver while the plan is made, and an exchange
    that both sides have is run once."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def scaling_factors(annotated: DataFrame, exact: bool = False) -> DataFrame:
    """Per category, each region once."""
    f = annotated.groupBy("category").agg(*_sum_pair(exact))
    return f.select("category", *[factor(f"{p}_raw", f"{p}_lnorm").alias(f"{p}_factor") for p in PAIR])


def total_factors(counts: DataFrame, exact: bool = False) -> DataFrame:
    """One row: factors over all the given regions."""
    t = counts.agg(*_sum_pair(exact))
    return t.select(*[factor(f"{p}_raw", f"{p}_lnorm").alias(f"{p}_factor") for p in PAIR])


def feature_counts(annotated: DataFrame, scaling: Scaling = Scaling.PER_REGION, exact: bool = False) -> DataFrame:
    """(category, feature) sums, scaled by the category's factor.  A region's full count goes to each of its features."""
    rows = annotated.withColumn("feature", F.explode("features"))
    out = rows.groupBy("category", "feature").agg(*_sum_pair(exact))
    if scaling is Scaling.PER_REGION:
        factors = scaling_factors(annotated, exact)
    else:
        f = rows.groupBy("category").agg(*_sum_pair(exact))
        factors = f.select("category", *[factor(f"{p}_raw", f"{p}_lnorm").alias(f"{p}_factor") for p in PAIR])
    out = out.join(factors, "category")
    return out.select("category", "feature", *[c for p in PAIR for c in (f"{p}_raw", f"{p}_lnorm", (F.col(f"{p}_lnorm") * F.col(f"{p}_factor")).alias(f"{p}_scaled"))])


def category_rows(annotated: DataFrame, counts: DataFrame, exact: bool = False) -> DataFrame:
    """One row for each category, each region once, scaled by the factor over all annotated regions."""
    out = annotated.groupBy("category").agg(*_sum_pair(exact))
    out = beside(out, total_factors(counts, exact))
    return out.select("category", *[c for p in PAIR for c in (f"{p}_raw", f"{p}_lnorm", (F.col(f"{p}_lnorm") * F.col(f"{p}_factor")).alias(f"{p}_scaled"))])


def gene_table(counts: DataFrame, exact: bool = False) -> DataFrame:
    """Counts of each gene with the factor over all genes."""
    out = beside(counts, total_factors(counts, exact))
    return out.withColumns({f"{p}_scaled": F.col(f"{p}_lnorm") * F.col(f"{p}_factor") for p in PAIR}).drop(*[f"{p}_factor" for p in PAIR])


def rpkm(table: DataFrame, reads: int) -> DataFrame:
    return table.withColumns({c.replace("_lnorm", "_rpkm"): F.col(c) * 1e9 / F.lit(float(reads)) for c in table.columns if c.endswith("_lnorm")})


def with_unseen(counts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Features that were never counted, as zeros, in the categories that have any count."""
    seen = counts.select("category").distinct()
    dim = dimension.join(seen, "category", "left_semi").select("category", "feature").distinct()
    metrics = [c for c in counts.columns if c not in ("category", "feature")]
    return dim.join(counts, ["category", "feature"], "left").fillna(0.0, metrics)


def restrict(table: DataFrame, metrics: tuple[str, ...], ambiguous: bool = True, stranded: bool = False) -> DataFrame:
    """Key columns and the metrics asked for, in report order."""
    keys = [c for c in table.columns if not c.startswith(("uniq_", "combined_", "ambig_"))]
    cols = []
    for suffix in ("", *(("_ss", "_as") if stranded else ())):
        for p in PAIR if ambiguous else PAIR[:1]:
            cols += [f"{p}_{m}{suffix}" for m in metrics]
    return table.select(*keys, *[c for c in cols if c in table.columns])


def gene_group_counts(counts: DataFrame, ref: str, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by the hexadecimal group after the last point of the reference name, joined to the groups' annotations after
    they were summed; group 0 is unannotated."""
    key = F.conv(F.substring_index(ref, ".", -1), 16, 10).cast("bigint")
    metrics = [c for c in counts.columns if c.startswith(("uniq_", "combined_", "ambig_"))]
    g = counts.groupBy(key.alias("id")).agg(*[F.sum(c).alias(c) for c in metrics])
    return g.where("id <> 0").join(groups, "id"), g.where("id = 0")


def unannotated(counts: DataFrame, annotations: DataFrame, on: str, exact: bool = False) -> DataFrame:
    """Counts of what has no annotation at all."""
    rest = counts.join(annotations.select(on).distinct().hint("merge"), on, "left_anti")
    return rest.agg(*[F.coalesce(sums.total(F.col(f"{p}_raw"), exact), F.lit(0.0)).alias(f"{p}_raw") for p in PAIR])
