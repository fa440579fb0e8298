"""One-off conversion of an SQLite annotation database to a Parquet store."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_ROWS = 100_000  # rows held by the driver at a time


def convert(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Sequences with their categories and features, decoded from the dictionary codes; returns the stored table."""
    con = sqlite3.connect(path)
    cats = spark.createDataFrame(con.execute("select id, name from category").fetchall() or [(-1, "")], "cid int, category string")
    feats = spark.createDataFrame(con.execute("select id, name from feature").fetchall() or [(-1, "")], "fid int, feature string")
    rows = con.execute('select seqid, featureid, start, "end", strand, annotation_str from annotatedsequence')
    mode = "overwrite"
    while chunk := rows.fetchmany(TABLE_ROWS):
        spark.createDataFrame(chunk, "seqid string, featureid string, start_pos int, end_pos int, strand int, annotation string").write.mode(mode).parquet(f"{out}/raw")
        mode = "append"
    con.close()
    raw = spark.read.parquet(f"{out}/raw")
    keys = ["seqid", "featureid", "start_pos", "end_pos", "strand"]
    part = raw.select(*keys, F.explode(F.split("annotation", ";")).alias("p")).where("p <> ''")
    codes = part.select(*keys, F.substring_index("p", "=", 1).cast("int").alias("cid"), F.explode(F.split(F.substring_index("p", "=", -1), ",").cast("array<int>")).alias("fid"))
    long = codes.join(cats, "cid").join(feats, "fid").groupBy(*keys, "category").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    long.write.mode("overwrite").parquet(f"{out}/annotations")
    return spark.read.parquet(f"{out}/annotations")
