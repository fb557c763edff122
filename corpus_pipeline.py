"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage reads all rows that its predecessor kept, as (spark, docs, sf_dir), and all but the last return the
columns of ``documents``. Extra columns are left out. Empty tables pass through; texts of any length are read whole.
Rows are selected one by one: where ids are missing or occur twice, rows are numbered for the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, jaccard, langid, packing, pii
from docloom.llm._shared import selected, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, column that tells rows apart): the id, or a number of each row where ids are null or not unique."""
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return docs, "doc_id"
    return staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows"), "_row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null or no letter) go; the others carry the predicted one. Repeated rows all stay."""
    return langid.relabelled(docs, caches=langid.SMALL_CACHES).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal texts one row stays: the one with the least id, rows without an id last, and any
    one of rows with the same id. Null and wordless texts are near no other and stay."""
    docs, key = _rows(docs)
    classes = jaccard.jaccard_classes(docs, id_col=key)
    if key == "doc_id":
        leaders = classes.where("doc_id = component_id").select("doc_id")
    else:
        ids = docs.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
        leaders = classes.join(ids, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(first).select(F.col("first.row").alias(key))
    return selected(docs, leaders, key).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    docs, key = _rows(docs)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), id_col=key).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; rows and null texts stay as they are."""
    return pii.masked(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their place in sequences of 4096; null texts are a closing id."""
    return packing.packed(docs, caches=packing.SMALL_CACHES)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the language model, the span classifier or the packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
