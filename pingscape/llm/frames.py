"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import checkpoint_dir
from ..operators.checkpoints import cut as stored

__all__ = ["few", "key_of", "small_batches", "stored", "tasks", "without", "written"]

#: Spark's setting for the bytes of an Arrow batch, its default, and what whole texts are sent in.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
#: A list of keys to leave out is broadcast up to this many rows of 16 bytes.
MOST_KEYS = 200_000


def key_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, text_key): results that depend on the text alone are kept by (doc_id, text_key).

    Rows that repeat an id with another text stay apart; rows that repeat both get the same results.
    """
    text = F.col(f"`{text_column}`")
    return df.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.cast("string").alias("text"),
        F.xxhash64(text.cast("string")).alias("text_key"),
    )


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of BATCH_BYTES, where it still has the default of 64 MB.

    A batch is held by the JVM and by Python, and again as output, so its size decides the memory beside the heap.
    """
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it again: whole texts take less room than in checkpoints."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def few(df: DataFrame) -> bool:
    """Whether a stored table has so few rows of keys that joins may broadcast it instead of dealing out both sides."""
    return df.count() <= MOST_KEYS


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a table with doc_id and text whose (doc_id, text_key) is not in `keys`; null ids are ids.

    The keys are stored and counted; few are broadcast, so that texts are not shuffled, more are joined.
    """
    gone = stored(keys.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    text_key = F.xxhash64(df["text"].cast("string"))
    same = df["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_key == gone["gone_key"])
    return df.join(F.broadcast(gone) if gone.count() <= MOST_KEYS else gone, same, "left_anti")


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
