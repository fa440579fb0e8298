"""Report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def formatted(table: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles as text with a fixed number of digits; for sinks only.  Nulls stay null."""
    return table.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])


def write_table(table: DataFrame, path: str, key: str = "feature", by: str | None = None) -> None:
    """Gzipped TSV in order of the key.  With ``by``, one folder for each of its values: rows are dealt and sorted by it,
    so a value's file is written by one task without a global sort.  With a rank column, rows come in its order first."""
    order = [c for c in (by, "rank", key) if c and c in table.columns]
    t = table.repartition(by).sortWithinPartitions(*order) if by else table.repartition(1).sortWithinPartitions(*order)
    t = formatted(t.drop("rank"))
    w = t.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").option("compression", "gzip")
    (w.partitionBy(by) if by else w).csv(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_counters(counts: DataFrame, references: DataFrame, path: str) -> None:
    """Raw counters with their references' names and lengths."""
    counts.join(references, "rid").write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
