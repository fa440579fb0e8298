"""Depth and breadth of coverage of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sums

REGION = ["rid", "start_pos", "end_pos"]
TILE = 1 << 16


def segments(hits: DataFrame, exact: bool = False) -> DataFrame:
    """Summed weight of each covered stretch of each region, unique and ambiguous reads apart."""
    return hits.groupBy(*REGION, "ambiguous", "cov_start", "cov_end").agg(sums.total(F.col("contrib"), exact).alias("weight"))


def depth_per_base(seg: DataFrame, exact: bool = False) -> DataFrame:
    """Depth of each covered base.  What is shuffled are segments, cut at every TILE bases so that a long region is no
    single task's; their ends are swept, unique and ambiguous ones apart, and only the runs of equal depth that come out of
    the sweep are spread to bases."""
    keys = [*REGION, "ambiguous", "tile"]
    tile = F.explode(F.sequence(F.floor(F.col("cov_start") / TILE), F.floor(F.col("cov_end") / TILE)))
    seg = seg.where("cov_end >= cov_start").withColumn("tile", tile).repartition(*keys)
    low = (F.col("tile") * TILE).cast(seg.schema["cov_start"].dataType)
    seg = seg.withColumns({"cov_start": F.greatest("cov_start", low), "cov_end": F.least("cov_end", low + TILE - 1)})
    unit = F.round(F.col("weight") * float(sums.UNITS)).cast("bigint") if exact else F.col("weight")
    known = F.when(unit.isNotNull(), 1).otherwise(0)
    ends = F.array(
        F.struct(F.col("cov_start").alias("at"), unit.alias("u"), known.alias("k"), F.lit(1).alias("n")),
        F.struct((F.col("cov_end") + 1).alias("at"), (-unit).alias("u"), (-known).alias("k"), F.lit(-1).alias("n")),
    )
    ev = seg.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*")
    w = Window.partitionBy(*keys).orderBy("at")  # ends at one base have one sum, and a run of no length before the last of them
    run = ev.select(*keys, F.col("at").alias("run_start"), (F.lead("at").over(w) - F.col("at")).alias("run_len"), *[F.sum(c).over(w).alias(c) for c in ("u", "k", "n")])
    depth = F.when(F.col("k") > 0, F.col("u") / F.lit(float(sums.UNITS)) if exact else F.col("u"))
    base = F.explode(F.sequence("run_start", F.col("run_start") + F.col("run_len") - 1)).alias("base")
    return run.where("n > 0 and run_len > 0").select(*keys, depth.alias("depth"), base).select(*REGION, "ambiguous", "base", "depth")


def depth_runs(seg: DataFrame, exact: bool = False) -> DataFrame:
    """Runs of equal depth by a sweep over the segments' ends: rows grow with segments, not with bases.

    Columns: region, run_start, run_len, uniq_depth, ambig_depth, and n_uniq / n_all open segments."""
    w = F.col("weight")
    zero = F.lit(0).cast("bigint") if exact else F.lit(0.0)
    unit = F.round(w * float(sums.UNITS)).cast("bigint") if exact else w
    u, a = F.when(~F.col("ambiguous"), unit).otherwise(zero), F.when(F.col("ambiguous"), unit).otherwise(zero)
    one = F.when(~F.col("ambiguous"), 1).otherwise(0)
    ev = seg.where("cov_end >= cov_start").select(*REGION, F.explode(F.array(
        F.struct(F.col("cov_start").alias("at"), u.alias("u"), a.alias("a"), one.alias("nu"), F.lit(1).alias("n")),
        F.struct((F.col("cov_end") + 1).alias("at"), (-u).alias("u"), (-a).alias("a"), (-one).alias("nu"), F.lit(-1).alias("n")),
    )).alias("e")).select(*REGION, "e.*")
    ev = ev.groupBy(*REGION, "at").agg(*[F.sum(c).alias(c) for c in ("u", "a", "nu", "n")])
    w_ = Window.partitionBy(*REGION).orderBy("at")
    run = ev.select(*REGION, F.col("at").alias("run_start"), (F.lead("at").over(w_) - F.col("at")).alias("run_len"), *[F.sum(c).over(w_).alias(c) for c in ("u", "a", "nu", "n")])
    scale = F.lit(float(sums.UNITS)) if exact else F.lit(1.0)
    return run.where("n > 0").select(*REGION, "run_start", "run_len", (F.col("u") / scale).alias("uniq_depth"), (F.col("a") / scale).alias("ambig_depth"), "nu", "n")


def metrics(runs: DataFrame, exact: bool = False) -> DataFrame:
    """Depth (over the region), depth of covered bases and covered share, for unique and for all reads."""
    length = F.col("end_pos") - F.col("start_pos") + 1
    combined = F.col("uniq_depth") + F.col("ambig_depth")
    g = runs.groupBy(*REGION).agg(
        sums.total(F.col("uniq_depth") * F.col("run_len"), exact).alias("su"), sums.total(combined * F.col("run_len"), exact).alias("sc"),
        F.sum(F.when(F.col("nu") > 0, F.col("run_len")).otherwise(0)).alias("bu"), F.sum("run_len").alias("bc"),
    )
    out = [*REGION]
    for name, s, b in (("uniq", "su", "bu"), ("combined", "sc", "bc")):
        out += [(F.col(s) / length).alias(f"{name}_depth"), F.coalesce(F.try_divide(F.col(s), F.col(b)), F.lit(0.0)).alias(f"{name}_depth_covered"), (F.col(b) / length).alias(f"{name}_horizontal")]
    return g.select(*out)


def by_feature(metric: DataFrame, annotations: DataFrame, exact: bool = False) -> DataFrame:
    """Mean covered share and summed depth of each feature's regions."""
    rows = metric.join(annotations.hint("merge"), REGION).withColumn("feature", F.explode("features"))
    aggs = []
    for p in ("uniq", "combined"):
        aggs.append((sums.total(F.col(f"{p}_horizontal"), exact, norm=True) / F.count("*")).alias(f"{p}_horizontal"))
        aggs.append(sums.total(F.col(f"{p}_depth"), exact, norm=True).alias(f"{p}_depth"))
    return rows.groupBy("category", "feature").agg(*aggs)
