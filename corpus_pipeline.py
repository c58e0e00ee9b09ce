"""The corpus pipeline: quality, near duplicates, repeated strings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. SQL cannot express the stages, so the result is
tested against a brute-force version.

Edge cases: null and empty texts stay documents, and are one class of near duplicates; a null doc_id is kept, and stays of a
class only if it has no other; repeated rows are one class; of rows with one doc_id and unlike texts each is judged on its
own; columns besides doc_id and text are carried along whatever their names, and n_chars is counted anew where a text
changes; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import compression_quality, neardup, packing, pii, suffix_dedup
from provlake.llm.common import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_quality.fit(docs.select("doc_id", "text"), labels)
    # the row is held in one column, so that its names cannot clash with the model's
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("string").alias("text"))
    return compression_quality.apply(rows, model).where("predicted = 1").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.first_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that a smaller document has go."""
    return suffix_dedup.cut_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids in as few sequences as can be."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("personal data", personal_data),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
