"""Registered query of operator 6."""

from pyspark.sql import functions as F

from . import common as C
from . import quality


def op6_quality_classifier(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, C.read(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.remainder() == quality.HELD_OUT, F.lit(False))
    return quality.predict(docs.withColumn("held_out", held_out), weights).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
