"""Annotation stores: long and grouped forms, dictionaries and codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_features(c: Column, na: str = "-") -> Column:
    """Distinct comma-separated items; empty for an empty or missing value."""
    return F.when(c.isNull() | (c == "") | (c == na), F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, ",")))


def cog_letters(c: Column) -> Column:
    """Letters of a COG category string, one feature each; repeated letters count again."""
    return F.split(F.regexp_replace(c, ",", ""), "")


def category_features(name: str, c: Column, na: str = "-") -> list[tuple[str, Column]]:
    """(category, features) that one annotation column gives."""
    if name == "eggNOG_OGs":
        return [(name, F.when(c.isNull() | (c == "") | (c == na), F.array().cast("array<string>")).otherwise(F.array(c)))]
    if name == "COG_category":
        plain = F.regexp_replace(c, ",", "")
        none = c.isNull() | (c == "") | (c == na)
        empty = F.array().cast("array<string>")
        return [
            (name, F.when(none, empty).otherwise(cog_letters(c))),
            ("COG_category_composite", F.when(none | (F.length(plain) <= 1), empty).otherwise(F.array(plain))),
        ]
    return [(name, split_features(c, na))]


def long_form(table: DataFrame, keys: list[str], columns: list[str], na: str = "-") -> DataFrame:
    """One row for each key and category that has features."""
    pairs = [F.struct(F.lit(n).alias("category"), f.alias("features")) for c in columns for n, f in category_features(c, F.col(c), na)]
    return table.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.category", "p.features").where(F.size("features") > 0)


def dictionary(long: DataFrame) -> DataFrame:
    """Codes of categories and features, in the order of their names: feature codes run on from category to category.
    Codes come from counts per category, so no window holds more than one category's features."""
    pairs = long.select("category", F.explode("features").alias("feature")).distinct()
    sizes = pairs.groupBy("category").agg(F.count("*").alias("n"))
    w = Window.orderBy("category")  # over the categories, of which there are few
    base = sizes.select("category", (F.row_number().over(w) - 1).alias("category_id"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("feature"))
    return pairs.withColumn("r", rank).join(base, "category").select("category", "feature", "category_id", (F.col("before") + F.col("r") - 1).alias("feature_id"))


def encode(long: DataFrame, keys: list[str]) -> DataFrame:
    """``category=feature,feature;category=...`` of each key, all in order of their names."""
    item = F.concat(F.col("category"), F.lit("="), F.array_join(F.array_sort("features"), ","))
    return long.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(item)), ";").alias("annotation"))


def decode(encoded: DataFrame, keys: list[str], column: str = "annotation") -> DataFrame:
    part = F.explode(F.split(F.col(column), ";")).alias("p")
    return encoded.select(*keys, part).select(*keys, F.substring_index("p", "=", 1).alias("category"), F.split(F.expr("substring(p, instr(p, '=') + 1)"), ",").alias("features"))


def dedup_by_hash(table: DataFrame, annotation: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct annotation strings by their sha256, rows that name the hash)."""
    rows = table.withColumn("annotation_hash", F.sha2(F.col(annotation), 256))
    return rows.select("annotation_hash", annotation).dropDuplicates(["annotation_hash"]), rows.select(*keep, "annotation_hash")


def fasta(rows: DataFrame, name: str, sequence: str) -> DataFrame:
    """FASTA records, named by the sequence's id and its annotation's hash."""
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("."), F.col("annotation_hash"), F.lit("\n"), F.col(sequence)).alias("value"))


def strand_code(c: Column) -> Column:
    return F.when(c == "+", 1).when(c.isNull(), None).otherwise(0)


def duplicate_seqids(store: DataFrame) -> DataFrame:
    """Sequences that a gene store has more than once; a valid one has none."""
    return store.groupBy("seqid").agg(F.count("*").alias("n")).where("n > 1")


def code_map(codes: DataFrame) -> DataFrame:
    """One JSON object of each category: its code and its features' codes."""
    features = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "feature_id"))))
    return codes.groupBy("category").agg(F.to_json(F.struct(F.first("category_id").alias("key"), features.alias("features"))).alias("json"))


def write_store(long: DataFrame, path: str) -> None:
    """Parquet store: annotations and the dictionary of their features."""
    long.write.mode("overwrite").parquet(f"{path}/annotations")
    dictionary(long).write.mode("overwrite").parquet(f"{path}/dictionary")


def read_store(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/annotations"), spark.read.parquet(f"{path}/dictionary")
