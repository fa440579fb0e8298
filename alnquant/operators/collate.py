"""Collation of many samples' tables to one matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows that stand before the features, in this order (fixed values)
SPECIAL = ("total_reads", "filtered_reads", "category", "unannotated")
#: metrics that can be collated (fixed values)
COLUMNS = (
    "uniq_raw", "uniq_lnorm", "uniq_scaled", "uniq_rpkm", "combined_raw", "combined_lnorm", "combined_scaled", "combined_rpkm",
    "uniq_depth", "uniq_depth_covered", "uniq_horizontal", "combined_depth", "combined_depth_covered", "combined_horizontal",
)


def special_rank(label: str = "feature"):
    rank = F.lit(len(SPECIAL))
    for i, s in enumerate(SPECIAL):
        rank = F.when(F.col(label) == s, i).otherwise(rank)
    return rank


def metric_or_fallback(long: DataFrame, metric: str):
    """The metric, or where a sample has no combined column its unique one; a fallback of one file is no other's."""
    if metric.startswith("combined_") and metric.replace("combined_", "uniq_", 1) in long.columns:
        return F.coalesce(F.col(metric), F.col(metric.replace("combined_", "uniq_", 1)))
    return F.col(metric)


def matrix(long: DataFrame, samples: list[str], metric: str, label: str = "feature", index: DataFrame | None = None) -> DataFrame:
    """One row for each feature, one column for each sample, null where a sample lacks it; an index restricts the rows.
    The samples are given, so no job has to find them."""
    picked = long.where(F.col("sample").isin(samples)).select(label, "sample", metric_or_fallback(long, metric).alias("__v"))
    if index is not None:
        picked = index.select(label).distinct().join(picked, label, "left")
    return picked.groupBy(label).pivot("sample", samples).agg(F.first("__v", ignorenulls=True))


def ordered(m: DataFrame, label: str = "feature") -> DataFrame:
    return m.orderBy(special_rank(label), label)


def merge_studies(matrices: list[DataFrame], label: str = "feature") -> DataFrame:
    """Full outer merge by feature: one long union and one aggregate in place of a chain of joins."""
    names = [c for m in matrices for c in m.columns if c != label]
    parts = [m.select(label, *[F.col(c) if c in m.columns else F.lit(None).cast("double").alias(c) for c in names]) for m in matrices]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(label).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def stats_matrix(long: DataFrame, samples: list[str]) -> DataFrame:
    """Total, Passed, Seqid, Length by sample."""
    rank = F.expr("array_position(array('Total', 'Passed', 'Seqid', 'Length'), stat)")
    return long.groupBy("stat").pivot("sample", samples).agg(F.first("n").cast("double")).orderBy(rank)


def eav(observations: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Observations with the names of their samples and features."""
    return observations.join(F.broadcast(samples) if samples.count() <= 100_000 else samples, "sample_id").join(features, "feature_id")


def split_table(lines: DataFrame, order: str = "line_no", text: str = "line", by: list[str] | None = None) -> DataFrame:
    """Rows of a table in which ``#name`` lines begin categories, each with its category's name."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col(text).startswith("#"), F.substring(text, 2, 1 << 20))
    return lines.withColumn("category", F.last(name, ignorenulls=True).over(w)).where(~F.col(text).startswith("#"))
