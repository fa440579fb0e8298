"""Counting alignment files as they arrive.

Each file is a stream of its own and is read whole in one micro-batch, so a read's alignments are together and no state or
watermark is needed.  A batch adds its (reference, unique, ambiguous) sums to a Parquet table under its batch id; a batch
that is run again replaces its own part, so the totals count each file once.  Scaling happens when the totals are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ProfileConfig
from ..operators import align, counts, weight
from ..sources import sam


def _batch_counts(aln: DataFrame, cfg: ProfileConfig) -> DataFrame:
    rows = align.passed(align.derive(aln), cfg.min_seqlen, cfg.min_identity).withColumn("rid", F.col("refname"))
    w = weight.weighted(weight.groups(rows, ambiguous_by=cfg.ambiguous_by), cfg.ambiguity, cfg.paired_end_count, cfg.unmarked_orphans, cfg.rg_policy)
    return counts.seq_counts(w, cfg.exact_sums)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: ProfileConfig = ProfileConfig(), once: bool = True) -> StreamingQuery:
    """Watch a folder of SAM files; with ``once`` it ends when all files that are there now were counted."""
    lines = spark.readStream.format("text").option("wholetext", False).load(folder).select(F.col("_metadata.file_path").alias("stream_id"), "value")

    def add(batch: DataFrame, batch_id: int) -> None:
        _batch_counts(sam.parse_lines(batch), cfg).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Counts of all batches so far."""
    t = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return t.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("uniq_raw", "ambig_raw", "combined_raw")])
