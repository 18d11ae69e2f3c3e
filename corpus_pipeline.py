"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes
each stage's result as Parquet to the shared folder, deletes what the stage wrote on its way, and hands the
result to the next stage. All stages but the last return the columns of documents, extra columns included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from veinstone.llm.common import ROW, numbered
from veinstone.llm.queries import table, tokenizer_path
from veinstone.storage import written_alone

#: Near copies share four fifths of their five-word shingles.
SHINGLE, PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects (null, letterless or uncertain text) go."""
    name = "__vs_language"
    judged = language_id.predict(docs, language_id.fit(docs), name)
    return _columns(judged.where(~F.col(f"{name}.rejected")), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines go; a document that loses its every line goes with them."""
    cut = line_dedup.dedup_lines(docs)
    cut = cut.where((F.col("__vs_cut") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__vs_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _columns(cut, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar rows one stays: that of the smallest id, a null id last."""
    rows = numbered(docs)
    classes = jaccard_join.jaccard_components(rows, key=ROW, shingle=SHINGLE, percent=PERCENT)
    named = classes.join(rows.select(ROW, "doc_id"), ROW)
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    # by row ids, which are unique: a class with a third of all rows is no hot key of a join
    first = named.groupBy("component_id").agg(F.min(at).alias("first")).select(F.col("first.row").alias(ROW))
    return _columns(rows.join(first, ROW, "left_semi"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token pieces in packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: The language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
