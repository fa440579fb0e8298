"""Interval joins of alignments and annotated regions.

A region is 1-based and closed, an alignment 0-based and half-open, and the rules differ in how they mix the two.  Small
region sets are broadcast and tested per reference; larger ones are joined on (reference, bin), both sides spread to the
bins that they touch, and a pair is kept in the first bin that both have, so it appears once without a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Overlap

BIN = 128
BROADCAST_ROWS = 200_000


def bounds(rule: Overlap) -> tuple[Column, Column, Column, Column]:
    """(query first, query last, region first, region last) as closed intervals whose overlap is the rule's hit."""
    qs, qe, s, e = F.col("q_start"), F.col("q_end"), F.col("start_pos"), F.col("end_pos")
    if rule is Overlap.SMALL_GENOME:
        return qs, qe, s, e
    if rule is Overlap.DOMAIN:
        return qs, qe, s - 1, e - 1
    if rule is Overlap.EXACT:
        return qs + 1, qe, s, e
    return qs, qe - 1, s, e  # half-open query against the closed region as it stands


def sized(dimension: DataFrame) -> DataFrame:
    """A frame to join with, by broadcast if it has few rows (counted, not guessed from its files), else by sort and merge."""
    return F.broadcast(dimension) if dimension.count() <= BROADCAST_ROWS else dimension.hint("merge")


def overlap(aln: DataFrame, regions: DataFrame, rule: Overlap = Overlap.SMALL_GENOME, ref: str = "rid", seqid: str = "seqid", bin_size: int | None = None, clip: bool = True, outer: bool = False) -> DataFrame:
    """All (alignment, region) pairs that hit, with the covered part.  ``regions`` has start_pos, end_pos; without
    ``bin_size`` the plan is chosen by the number of regions.  With ``outer`` every alignment also stays: one without a hit
    as a row with a null start_pos, and one with hits may have such a row beside them."""
    how = "left" if outer else "inner"
    qa, qb, ra, rb = bounds(rule)
    left = aln.withColumns({"__qa": qa, "__qb": qb})
    right = regions.withColumnsRenamed({seqid: "__seqid"}).withColumns({"__ra": ra, "__rb": rb})
    hit = (F.col("__ra") <= F.col("__qb")) & (F.col("__rb") >= F.col("__qa"))
    if bin_size is None and regions.count() <= BROADCAST_ROWS:
        out = left.join(F.broadcast(right), (left[ref] == right["__seqid"]) & hit, how)
    else:
        size = bin_size or BIN
        spread = F.explode_outer if outer else F.explode
        left = left.withColumn("__bin", spread(F.sequence(F.floor(F.col("__qa") / size), F.floor(F.col("__qb") / size))))
        right = right.withColumn("__rbin", F.explode(F.sequence(F.floor(F.col("__ra") / size), F.floor(F.col("__rb") / size))))
        first = F.floor(F.greatest(F.col("__qa"), F.col("__ra")) / size)
        out = left.join(right.hint("merge"), (left[ref] == right["__seqid"]) & (F.col("__bin") == F.col("__rbin")) & hit, how).where((F.col("__bin") == first) | F.col("__bin").isNull())
    out = out.drop("__qa", "__qb", "__ra", "__rb", "__bin", "__rbin", "__seqid")
    if clip:
        out = out.withColumns({"cov_start": F.greatest("q_start", "start_pos"), "cov_end": F.least("q_end", "end_pos")})
    return out


def merge_regions(annotations: DataFrame) -> DataFrame:
    """One row for each (seqid, start, end) with the features of all its rows."""
    return annotations.groupBy("seqid", "start_pos", "end_pos").agg(F.array_sort(F.collect_set("feature")).alias("features"))


def covered_fraction() -> Column:
    return F.try_divide(F.col("cov_end") - F.col("cov_start") + 1, F.col("end_pos") - F.col("start_pos") + 1)
