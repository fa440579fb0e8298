"""Alignment-shaped views over the benchmark's relational tables.

Orders are reads, line items their alignments, parts the references; a part's brand, type and name words are its
annotation, and up to three overlapping stretches of it are regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import overlap


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    li = li.withColumn("ln", F.row_number().over(w)).withColumn("rg", (F.lit(1) + F.col("l_orderkey") % 2).cast("int"))
    flag = (
        F.when(F.col("rg") == 2, F.lit(1) + F.when(F.col("ln") % 2 == 0, 128).otherwise(64)).otherwise(0)
        + F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
        + F.when(F.col("ln") > F.col("rg"), 256).otherwise(0)
        + F.when(F.col("l_suppkey") % 50 == 3, 4).otherwise(0)
        + F.when(F.col("l_suppkey") % 50 == 7, 2048).otherwise(0)
    )
    alen = F.expr("cast(40 + l_quantity as int)")
    li = li.join(overlap.sized(part), li.l_partkey == part.p_partkey)
    li = li.withColumns({"reflength": (F.lit(200) + 20 * F.col("p_size")).cast("int"), "alen": alen})
    return li.select(
        F.lit(0).alias("stream_id"),
        (F.col("l_orderkey") * 64 + F.col("ln")).alias("aln_id"),
        F.col("l_orderkey").alias("qname"),
        F.col("l_partkey").alias("rid"),
        "rg",
        flag.cast("int").alias("flag"),
        "reflength",
        "alen",
        F.expr("cast(floor(round(l_discount * 100) / 2) as int)").alias("nm"),
        F.expr("cast(cast(round(l_extendedprice * 100) as bigint) % (reflength - alen) as int)").alias("pos"),
        (F.col("l_suppkey") % 61).cast("int").alias("mapq"),
        F.year("l_shipdate").cast("bigint").alias("sample_year"),
        "l_suppkey",
        "l_quantity",
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("rid"), (F.lit(200) + 20 * F.col("p_size")).cast("int").alias("reflength"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, category, features; every tenth part has none."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 <> 0")
    pair = F.array(
        F.struct(F.lit("brand").alias("category"), F.array("p_brand").alias("features")),
        F.struct(F.lit("type").alias("category"), F.array("p_type").alias("features")),
        F.struct(F.lit("token").alias("category"), F.array_distinct(F.split("p_name", " ")).alias("features")),
    )
    return p.select(F.col("p_partkey").alias("rid"), F.explode(pair).alias("p")).select("rid", "p.*")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 <> 0")
    i = F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))).alias("i")
    p = p.select(F.col("p_partkey").alias("seqid"), "p_size", "p_brand", i)
    return p.select("seqid", (1 + 60 * F.col("i")).cast("int").alias("start_pos"), (100 + 60 * F.col("i") + F.col("p_size")).cast("int").alias("end_pos"), F.col("p_brand").alias("feature"), (F.col("i") % 2 == 1).alias("on_minus"))
