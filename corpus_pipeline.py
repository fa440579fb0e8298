"""A cleaning and encoding pipeline over ``documents``: each stage works on all that the one before it kept.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> benchmark decontamination -> SentencePiece encoding.
Counted as part of the subpackage ``alnquant.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnquant.llm import common as C
from alnquant.llm import parity, quality, suffix_dedup, wfst, winnow

SAME_ROW = "doc_id <=> __doc and __key = __text"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row by its text; a null text is scored as an empty one."""
    weights = quality.train(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
    return quality.predict(docs, weights).where("predicted = 1").select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more): the one with the smallest doc_id.

    Rows are told apart by (doc_id, text): of repeated rows one stays, and of several texts with one doc_id each is judged
    by itself.  A row with a null doc_id goes if a row with one is a near copy; of equal rows without ids one stays.
    Texts without words are near copies of nothing and all stay.
    """
    C.release(spark)
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key")
    groups = parity.components(docs.select("doc_id", "text", key), k=5, num=80, also=("__key",)).where("n_shingles > 0")
    later = groups.where("component_id <> doc_id or (doc_id is null and component_id is not null)").select("doc_id", "__key")
    own = groups.where("component_id = doc_id").groupBy("doc_id").agg(F.min("__key").alias("one"), F.max("__key").alias("other"))
    twin = groups.where("component_id = doc_id").join(own.where("one <> other"), "doc_id").where("__key <> one").select("doc_id", "__key")
    gone = _keys(later.union(twin).distinct())
    again = _keys(groups.groupBy("doc_id", "__key").count().where("count > 1"))
    left = docs.select(*COLUMNS, key).join(gone, F.expr(SAME_ROW), "left_anti")
    if again.isEmpty():
        return left.select(COLUMNS)
    rest, repeated = left.join(again, F.expr(SAME_ROW), "left_anti"), left.join(again, F.expr(SAME_ROW), "left_semi")
    return rest.union(repeated.dropDuplicates(["doc_id", "__key"])).select(COLUMNS)


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("__doc"), F.col("__key").alias("__text"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; what is left empty by that goes.

    Rows with one doc_id, and rows without, take nothing from each other; null and empty texts stay as they are.
    """
    C.release(spark)
    out = suffix_dedup.remove_repeats(docs, span=50, text_out=True)
    out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.where("n_removed = 0 or length(trim(text)) > 0").select(COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: none has WINDOW words of it or more, however long it is, and none
    has as much as operator 10 calls contaminated, which is less where the document or the items are short."""
    return winnow.scan(docs, C.read(spark, sf_dir, "benchmark")).where(F.col("n_hit") < winnow.WINDOW).where("not contaminated").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, with the text that they decode to."""
    import public_tokenizers

    return wfst.transduce(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_ids", "ids_crc32", "round_trip", "ids", "decoded"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", keep_uncontaminated),
    ("sentencepiece", encode),
]

#: the classifier is trained and the encoding is a transducer's: SQL expresses neither
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
