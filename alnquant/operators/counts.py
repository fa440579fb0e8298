"""Counts of weighted alignments on references and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sums


def _counts(rows: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    g = rows.groupBy(*keys).agg(
        sums.weight_sum(F.col("contrib"), ~F.col("ambiguous"), exact).alias("uniq_raw"),
        sums.weight_sum(F.col("contrib"), F.col("ambiguous"), exact).alias("ambig_raw"),
        sums.weight_sum(F.col("contrib"), None, exact).alias("combined_raw"),
    )
    return g


def seq_counts(weighted: DataFrame, exact: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Unique, ambiguous and combined counts of each reference; ``extra`` keys split further, by strand say."""
    return _counts(weighted, ["rid", *extra], exact)


def region_counts(hits: DataFrame, exact: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The same for regions: every region that an alignment overlaps gets its full weight."""
    return _counts(hits, ["rid", "start_pos", "end_pos", *extra], exact)


def stranded(rows: DataFrame, keys: list[str], sense, exact: bool = False) -> DataFrame:
    """Counts of all, sense and antisense alignments side by side; ``sense`` is a boolean column."""
    aggs = []
    for suffix, on in (("", F.lit(True)), ("_ss", sense), ("_as", ~sense)):
        aggs.append(sums.weight_sum(F.col("contrib"), on & ~F.col("ambiguous"), exact).alias(f"uniq_raw{suffix}"))
        aggs.append(sums.weight_sum(F.col("contrib"), on, exact).alias(f"combined_raw{suffix}"))
    return rows.groupBy(*keys).agg(*aggs)


def normalise(counts: DataFrame, length) -> DataFrame:
    """Adds counts per base of the reference or region."""
    raw = [c for c in counts.columns if "_raw" in c and not c.startswith("ambig")]
    return counts.withColumns({c.replace("_raw", "_lnorm"): F.col(c) / length.cast("double") for c in raw})


def region_length():
    return F.col("end_pos") - F.col("start_pos") + 1
