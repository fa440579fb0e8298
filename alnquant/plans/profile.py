"""Whole profiles, from alignments to report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ProfileConfig, RunMode
from ..operators import align, counts, features, overlap, weight
from ..sources import bam, sam
from ..sources import counts as count_tables


def weighted_alignments(aln: DataFrame, cfg: ProfileConfig = ProfileConfig(), regions: DataFrame | None = None, ref: str = "rid") -> DataFrame:
    """Alignments that pass, are on target, and count in the mode, with their contribution: one shuffle by read.

    In region modes there is a row for each region that an alignment overlaps, with the region's columns and the covered part,
    from one interval join.  Its rows go on to the shuffle by read as they are; alignments are told apart there, by their
    order within the read, so none is joined to its hits and no lists of hits are kept in memory."""
    rows = align.passed(align.derive(aln), cfg.min_seqlen, cfg.min_identity)
    hit = None
    if cfg.mode.overlap_required:
        rows = align.on_target(rows, regions, ref)
        rows = overlap.overlap(rows, regions, cfg.overlap_rule, ref, outer=True)
        missed = F.col("start_pos").isNull()
        last = F.lag("aln_id").over(Window.partitionBy("stream_id", "qname").orderBy("aln_id", missed))
        rows = rows.withColumn("__hit", ~missed & (last.isNull() | (last != F.col("aln_id"))))  # the first hit of each alignment
        hit = F.col("__hit")
    g = weight.groups(rows, hit, cfg.ambiguous_by)
    out = weight.weighted(g, cfg.ambiguity, cfg.paired_end_count, cfg.unmarked_orphans, cfg.rg_policy)
    return out if hit is None else out.where("start_pos is not null").drop("__hit")


def gene_counts(aln: DataFrame, cfg: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Counts of each reference, with its length."""
    w = weighted_alignments(aln, cfg)
    c = counts.seq_counts(w.select("rid", "contrib", "ambiguous", "reflength"), cfg.exact_sums, ("reflength",))
    return counts.normalise(c, F.col("reflength"))


def region_counts(aln: DataFrame, regions: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Counts of each region; intervals that occur several times are hit once."""
    spans = regions.select("seqid", "start_pos", "end_pos").distinct()
    hits = weighted_alignments(aln, cfg, spans)
    return counts.normalise(counts.region_counts(hits, cfg.exact_sums), counts.region_length())


def feature_profile(aln: DataFrame, annotations: DataFrame, cfg: ProfileConfig = ProfileConfig(), regions: DataFrame | None = None) -> DataFrame:
    """(category, feature) table of a profile."""
    if cfg.mode is RunMode.GENE:
        c, on = gene_counts(aln, cfg), ["rid"]
    else:
        c, on = region_counts(aln, regions, cfg), ["rid", "start_pos", "end_pos"]
    return features.feature_counts(features.annotate(c, annotations, on), cfg.scaling, cfg.exact_sums)


def report(aln: DataFrame, annotations: DataFrame, cfg: ProfileConfig, regions: DataFrame | None = None) -> DataFrame:
    """Report rows of every category: special rows, then features by name, unseen ones as zeros.

    Columns: category, rank, feature, and the metrics of the configuration."""
    counted = gene_counts(aln, cfg) if cfg.mode is RunMode.GENE else region_counts(aln, regions, cfg)
    stats = align.read_stats(align.derive(aln), align.filter_status(cfg.min_seqlen, cfg.min_identity)).agg(F.sum("aligned_reads").alias("t"), F.sum("filtered_reads").alias("f")).first()
    return count_report(counted, annotations, cfg, (stats["t"] or 0, stats["f"] or 0))


def count_report(counted: DataFrame, annotations: DataFrame, cfg: ProfileConfig, reads: tuple[int, int] | None = None) -> DataFrame:
    """The same from counts; external ones come without numbers of reads, so their rows and RPKM are left out."""
    cached = counted.cache()
    on = ["rid"] if cfg.mode is RunMode.GENE else ["rid", "start_pos", "end_pos"]
    ann = features.annotate(cached, annotations, on)
    feats = features.feature_counts(ann, cfg.scaling, cfg.exact_sums)
    if cfg.report_unseen:
        feats = features.with_unseen(feats, annotations.select("category", F.explode("features").alias("feature")))
    keyed = features.annotated(cached, annotations, on)
    cats = features.category_rows(ann, keyed, cfg.exact_sums)
    metrics = [c for c in feats.columns if c not in ("category", "feature")]
    rows = [
        cats.select("category", F.lit(rank).alias("rank"), F.lit(name).alias("feature"), *[F.lit(float(n)).alias(m) for m in metrics])
        for rank, name, n in zip((1, 2), ("total_reads", "filtered_reads"), reads or ())
    ]
    rows.append(cats.select("category", F.lit(3).alias("rank"), F.lit("category").alias("feature"), *metrics))
    rows.append(feats.select("category", F.lit(4).alias("rank"), "feature", *metrics))
    if cfg.mode.report_unannotated:
        u = features.unannotated(cached, annotations, "rid", cfg.exact_sums).first()
        rows.append(cats.select("category", F.lit(0).alias("rank"), F.lit("unannotated").alias("feature"), *[F.lit(u[m] if m in ("uniq_raw", "combined_raw") else None).cast("double").alias(m) for m in metrics]))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    if "rpkm" in cfg.restrict_metrics and reads:
        out = features.rpkm(out, max(1, reads[1]))
    return features.restrict(out, cfg.restrict_metrics)


def read_alignments(spark: SparkSession, cfg: ProfileConfig) -> DataFrame:
    """Alignments of the configured SAM or BAM files, as a profile takes them: references go by their names, and each
    alignment has an id and its reference's length."""
    if cfg.inputs.get("sam"):
        paths = list(cfg.inputs["sam"])
        aln = sam.with_references(sam.read_sam(spark, paths), sam.read_references(spark, paths))
    else:
        aln = bam.read_bam(spark, ",".join(cfg.inputs["bam"]))
    return aln.withColumns({"rid": F.col("refname"), "aln_id": F.monotonically_increasing_id()})


def report_of_files(spark: SparkSession, cfg: ProfileConfig, annotations: DataFrame) -> DataFrame:
    """From alignment files or external gene counts to the report.  ``annotations`` are those of a reader: seqid, category,
    features, and in region modes start_pos, end_pos, by which reads are counted."""
    named = annotations.withColumnRenamed("seqid", "rid")
    if cfg.inputs.get("gene_counts"):
        counted = count_tables.read_gene_counts(spark, list(cfg.inputs["gene_counts"])).withColumnRenamed("gene", "rid")
        return count_report(counted, named, cfg)
    regions = annotations.select("seqid", "start_pos", "end_pos").distinct() if cfg.mode.overlap_required else None
    return report(read_alignments(spark, cfg), named, cfg, regions)
