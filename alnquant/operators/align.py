"""Alignment columns, filters and read statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sam


def derive(aln: DataFrame) -> DataFrame:
    """Half-open reference interval, mate and strand of each alignment; the aligned length comes from the CIGAR string
    where there is no ``alen`` column."""
    if "alen" not in aln.columns:
        aln = aln.withColumn("alen", sam.ref_length())
    return aln.withColumns({"q_start": F.col("pos"), "q_end": F.col("pos") + F.col("alen"), "mate": sam.mate(), "rev_strand": sam.has("reverse")})


def identity(nm: str = "nm", alen: str = "alen") -> Column:
    return F.lit(1) - F.coalesce(F.col(nm), F.lit(0)) / F.col(alen).cast("double")


def filter_status(min_seqlen: int = 45, min_identity: float = 0.97, exclude: int = sam.FLAGS["supplementary"], require: int = 0) -> Column:
    """Why an alignment is dropped, or ``pass``.  The tests are made in this order and the first that fails counts."""
    flag = F.col("flag")
    return (
        F.when(sam.has("unmapped"), "unmapped")
        .when(flag.bitwiseAND(exclude) != 0, "excluded")
        .when(flag.bitwiseAND(require) != require, "not_required")
        .when(F.col("alen") < min_seqlen, "length")
        .when(identity() < min_identity, "seqid")
        .otherwise("pass")
    )


def passed(aln: DataFrame, min_seqlen: int = 45, min_identity: float = 0.97) -> DataFrame:
    return aln.where(filter_status(min_seqlen, min_identity) == "pass")


def read_stats(aln: DataFrame, status: Column, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Reads in, aligned and passed, and alignments by outcome.  Two levels: reads first, so no count is a distinct one."""
    reads = aln.withColumn("status", status).groupBy(*by, "qname").agg(
        F.max((~sam.has("unmapped")).cast("int")).alias("aligned"),
        F.max((F.col("status") == "pass").cast("int")).alias("passed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "seqid", "length")],
    )
    return reads.groupBy(*by).agg(
        F.count("*").alias("total_reads"), F.sum("aligned").alias("aligned_reads"), F.sum("passed").alias("filtered_reads"),
        F.sum("pass").alias("pass_alignments"), F.sum("seqid").alias("seqid_filtered"), F.sum("length").alias("length_filtered"),
    )


def rates(stats: DataFrame) -> DataFrame:
    """Alignment and pass rate in percent, a tenth of a percent exact."""
    return stats.withColumns({
        "alignment_rate": F.round(F.try_divide(F.col("aligned_reads"), F.col("total_reads")), 3) * 100,
        "pass_rate": F.round(F.try_divide(F.col("filtered_reads"), F.col("total_reads")), 3) * 100,
    })


def stats_table(stats: DataFrame) -> DataFrame:
    """Long form: Total, Passed, Seqid, Length."""
    return stats.selectExpr("stack(4, 'Total', pass_alignments + seqid_filtered + length_filtered, 'Passed', pass_alignments, 'Seqid', seqid_filtered, 'Length', length_filtered) as (stat, n)")


def on_target(aln: DataFrame, regions: DataFrame, ref: str = "rid", seqid: str = "seqid") -> DataFrame:
    """Alignments to references that have any annotation."""
    return aln.join(regions.select(F.col(seqid).alias(ref)).distinct().hint("merge"), ref, "left_semi")


def run_ids(rows: DataFrame, key: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Number of the run of equal keys that each row is in, in the given order; ``by`` are streams of their own.

    Without streams the rows are dealt to ranges of the first order column (a number or a time), so no task has to hold them
    all; each range counts its own runs, and one row of each range says where its count begins and whether its first run
    goes on from the range before."""

    def numbered(d: DataFrame, parts: list[str]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        begins = (F.row_number().over(w) == 1) | ~F.lag(key).over(w).eqNullSafe(F.col(key))
        return d.withColumn("__new", begins.cast("int")).withColumn("run_id", F.sum("__new").over(w)).drop("__new")

    if by:
        return numbered(rows, by)
    timed = dict(rows.dtypes)[order[0]] in ("timestamp", "timestamp_ntz", "date")
    first = (F.col(order[0]).cast("timestamp") if timed else F.col(order[0])).cast("double")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(first.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    place = sum(((first >= c).cast("int") for c in cuts), F.lit(0))
    d = numbered(rows.withColumn("__part", F.coalesce(place, F.lit(-1))), ["__part"])
    # the first and last row of each range, by row numbers that the window has already put in order
    w = Window.partitionBy("__part").orderBy(*order)
    d = d.withColumn("__at", F.row_number().over(w))
    ends = d.groupBy("__part").agg(F.min_by(key, "__at").alias("a"), F.max_by(key, "__at").alias("z"), F.max("run_id").alias("n"))
    w = Window.orderBy("__part")  # one row for each range
    ends = ends.withColumn("goes_on", ((F.row_number().over(w) > 1) & F.lag("z").over(w).eqNullSafe(F.col("a"))).cast("int"))
    ends = ends.select("__part", (F.sum("n").over(w) - F.col("n") - F.sum("goes_on").over(w)).alias("__before"))
    return d.join(F.broadcast(ends), "__part").withColumn("run_id", F.col("run_id") + F.col("__before")).drop("__part", "__before", "__at")


def aligned_pairs(aln: DataFrame) -> DataFrame:
    """Reads whose two primary alignments lie on one reference, with the borders of the fragment."""
    p = aln.where(sam.is_primary() & sam.has("paired"))
    g = p.groupBy("stream_id", "qname").agg(
        F.min("rid").alias("rid"), F.max("rid").alias("__r"), F.max((F.col("mate") == 1).cast("int")).alias("__1"), F.max((F.col("mate") == 2).cast("int")).alias("__2"),
        F.min("q_start").alias("frag_start"), F.max("q_end").alias("frag_end"),
    )
    return g.where("rid = __r and __1 = 1 and __2 = 1").drop("__r", "__1", "__2")


def reference_clashes(refs: DataFrame) -> DataFrame:
    """References that stand for several names or lengths; a valid set has none."""
    return refs.groupBy("rid").agg(F.count_distinct("refname", "reflength").alias("variants")).where("variants > 1")
