"""Count tables: one sample's external gene counts, or many samples' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: parts of file names that are never count tables (fixed values)
EXCLUDED = (".seqname.dist1", ".seqname.uniq", ".ambig_tmp", "Counter", "domain.coverage")


def read_gene_counts(spark: SparkSession, path) -> DataFrame:
    """gene, uniq_raw, uniq_lnorm, combined_raw, combined_lnorm of a report, gzipped or not."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(F.col("gene"), *[F.col(c).cast("double").alias(c) for c in ("uniq_raw", "uniq_lnorm", "combined_raw", "combined_lnorm")])


def read_reports(spark: SparkSession, folder: str, suffix: str = ".txt.gz", recursive: bool = True) -> DataFrame:
    """Long table of all reports in a folder: sample, category (the last part of the file's name), feature, and every
    metric as a double, null where a file lacks it.  The header of each file says which of its columns is which, so files of
    different metrics can be read together."""
    opts = {"recursiveFileLookup": str(recursive).lower(), "pathGlobFilter": f"*{suffix}"}
    t = spark.read.options(**opts).text(folder).select(F.col("_metadata.file_name").alias("file"), "value", F.monotonically_increasing_id().alias("__n"))
    for x in EXCLUDED:
        t = t.where(~F.col("file").contains(x))
    head = t.where(F.regexp_like("value", F.lit("^(feature|gene)\t"))).groupBy("file").agg(F.min_by("value", "__n").alias("head"))
    body = t.where(~F.regexp_like("value", F.lit("^(feature|gene)\t"))).join(head, "file")
    stem = F.expr(f"substring(file, 1, length(file) - {len(suffix)})")
    cells = F.map_from_arrays(F.split("head", "\t"), F.transform(F.sequence(F.lit(0), F.size(F.split("head", "\t")) - 1), lambda i: F.get(F.split("value", "\t"), i)))
    from ..operators.collate import COLUMNS

    long = body.select(F.regexp_extract(stem, r"^(.*)\.([^.]+)$", 1).alias("sample"), F.regexp_extract(stem, r"^(.*)\.([^.]+)$", 2).alias("category"), cells.alias("m"))
    return long.select("sample", "category", F.coalesce(F.try_element_at("m", F.lit("feature")), F.try_element_at("m", F.lit("gene"))).alias("feature"), *[F.try_element_at("m", F.lit(c)).try_cast("double").alias(c) for c in COLUMNS])


def read_stats_tables(spark: SparkSession, path) -> DataFrame:
    """sample, stat, n of headerless two-column tables."""
    t = spark.read.csv(path, sep="\t").select(F.col("_metadata.file_name").alias("file"), F.col("_c0").alias("stat"), F.col("_c1").cast("bigint").alias("n"))
    return t.select(F.regexp_extract("file", r"^([^.]+)", 1).alias("sample"), "stat", "n")


def read_count_total(text: str) -> int:
    """A read count given as a number, or as JSON with n_reads."""
    import json

    try:
        return int(text)
    except ValueError:
        return int(json.loads(text)["n_reads"])
