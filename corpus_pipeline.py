"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing; each stage reads what the one before it wrote."""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, linededup, mixing, simhash, toxicity
from tidemark.llm.common import table
from tidemark.runtime import shared_folder


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; documents stay, n_chars follows the text."""
    out = linededup.remove_repeated_lines(docs)
    chars = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", chars).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [("toxicity", remove_toxic), ("line_dedup", remove_repeated_lines), ("near_dedup", remove_near_duplicates), ("decontamination", remove_contaminated), ("mixing", mix_sources)]
ORACLE_SQL = None  # the classifier and the edit distances are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
