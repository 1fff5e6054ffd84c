"""What several operators of this package share: reading, words, written intermediate tables."""
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.runtime import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def saved(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's shared folder and read it back: the lineage ends here, a lost executor costs nothing, and the planner knows the size."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def word_count(text) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))
