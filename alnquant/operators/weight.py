"""Ambiguity and weights of the alignments of a read, in one shuffle by read name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AmbigMode, RgPolicy
from ..functions import sam


def groups(aln: DataFrame, hit: Column | None = None, ambiguous_by: str = "secondary") -> DataFrame:
    """Adds, for each read: whether it is ambiguous (any secondary alignment, or a mapping quality of 0), the alignments of
    each mate with a hit, and its library (the read groups' least and greatest)."""
    w = Window.partitionBy("stream_id", "qname")
    hit = F.lit(True) if hit is None else hit
    mark = sam.has("secondary") if ambiguous_by == "secondary" else F.col("mapq") == 0
    second = sam.has("second")
    return aln.withColumns({
        "ambiguous": F.max(mark).over(w),
        "n_mate1": F.count_if(hit & ~second).over(w),
        "n_mate2": F.count_if(hit & second).over(w),
        "rg_min": F.min("rg").over(w),
        "rg_max": F.max("rg").over(w),
    }).withColumn("n_alt", F.when(second, F.col("n_mate2")).otherwise(F.col("n_mate1")))


def library_conflicts(grouped: DataFrame) -> DataFrame:
    """Reads with two read groups, or, where some alignments have one, with none."""
    return grouped.where("rg_min <> rg_max or (rg is null and rg_min is not null)").select("stream_id", "qname").distinct()


def increment(paired_end_count: int = 1, unmarked_orphans: bool = False, policy: RgPolicy = RgPolicy.INFER) -> Column:
    """What a read adds: 1 for a single-end library, half of paired_end_count for a paired one.  Under STRICT a read whose
    alignments have no read group, or several, is an error."""
    half = F.lit(paired_end_count / 2.0)
    known = F.when(F.col("rg_min") == 1, F.lit(1.0)).when(F.col("rg_min") == 2, half)
    if policy is RgPolicy.STRICT:
        known = F.when(F.col("rg").isNotNull() & (F.col("rg_min") == F.col("rg_max")), known)  # of one read, all the same
        return known.otherwise(F.raise_error(F.lit("a read has no usable read group")).cast("double"))
    return known.otherwise(F.when(sam.has("paired"), half).otherwise(half if unmarked_orphans else F.lit(1.0)))


def weighted(grouped: DataFrame, mode: AmbigMode = AmbigMode.ONE_OVER_N, paired_end_count: int = 1, unmarked_orphans: bool = False, policy: RgPolicy = RgPolicy.INFER) -> DataFrame:
    """Alignments that count in the mode, with their contribution.  Whether a read is ambiguous was settled before."""
    out = grouped
    if not mode.allow_ambiguous:
        out = out.where(~F.col("ambiguous"))
    elif not mode.allow_secondary:
        out = out.where(~sam.has("secondary"))
    inc = increment(paired_end_count, unmarked_orphans, policy)
    share = F.when(F.col("ambiguous"), F.try_divide(inc, F.col("n_alt"))).otherwise(inc) if mode.divides else inc
    return out.withColumn("contrib", share)
