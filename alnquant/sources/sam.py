"""SAM text as a DataFrame of alignments, and its references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENT_DDL = "stream_id string, qname string, flag int, refname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, len_seq int, nm int, rg int, md string, tags map<string,string>"


def _tag(tags: Column, name: str) -> Column:
    return F.regexp_extract(tags, rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1)


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("stream_id"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines(stream_id, value): positions become 0-based, and sequences and qualities are not kept."""
    body = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split(F.col("value"), "\t", 12)
    d = body.select("stream_id", f.alias("f")).where("size(f) >= 11")
    tags = F.coalesce(F.get("f", F.lit(11)), F.lit(""))
    nm, rg, md = (_tag(tags, t) for t in ("NM", "RG", "MD"))
    pairs = F.expr("map_from_entries(transform(filter(split(coalesce(get(f, 11), ''), '\\t'), t -> t <> ''), t -> struct(substring(t, 1, 2) as k, substring(t, 6) as v)))")
    return d.select(
        "stream_id", F.col("f")[0].alias("qname"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("refname"),
        (F.col("f")[3].cast("int") - 1).alias("pos"), F.col("f")[4].cast("int").alias("mapq"), F.col("f")[5].alias("cigar"),
        F.col("f")[6].alias("rnext"), (F.col("f")[7].cast("int") - 1).alias("pnext"), F.col("f")[8].cast("int").alias("tlen"),
        F.length(F.col("f")[9]).alias("len_seq"), nm.try_cast("int").alias("nm"),
        rg.try_cast("int").alias("rg"), F.nullif(md, F.lit("")).alias("md"), pairs.alias("tags"),
    )


def read_sam(spark: SparkSession, path) -> DataFrame:
    """Alignments of SAM files (gzipped ones too); each file is a stream of its own."""
    return parse_lines(_lines(spark, path))


def read_references(spark: SparkSession, path) -> DataFrame:
    """refname, reflength of the @SQ lines."""
    sq = _lines(spark, path).where(F.col("value").startswith("@SQ\t"))
    return sq.select(F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("refname"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("reflength")).distinct()


def with_references(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds reflength; an alignment to a reference that the header lacks keeps a null."""
    return aln.join(refs, "refname", "left")


def write_sam(aln: DataFrame, path: str) -> None:
    """Alignments as headerless SAM text, without sequences."""
    line = F.concat_ws("\t", "qname", "flag", "refname", F.col("pos") + 1, F.coalesce("mapq", F.lit(255)), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"),
                       F.concat(F.lit("NM:i:"), F.coalesce("nm", F.lit(0))), F.when(F.col("rg").isNotNull(), F.concat(F.lit("RG:Z:"), "rg")))
    aln.select(line.alias("value")).write.mode("overwrite").text(path)
