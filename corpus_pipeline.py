"""From raw documents to packed training sequences.

STAGES are functions of (spark, docs, sf_dir). Each works on all rows that the stage before kept; all but the last
return the columns of their input. Each stage's result is written as Parquet before the next reads it.

For every stage: null and empty texts are texts without words; a null doc_id is an id like others where rows are taken out,
and is linked with nothing; an empty table gives an empty table; columns besides doc_id, text and n_chars are carried as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingscape.llm.decontamination import contamination
from pingscape.llm.frames import without, written
from pingscape.llm.near_dedup import near_duplicates
from pingscape.llm.packing import pack
from pingscape.llm.queries import table, tokenizer_path
from pingscape.llm.substring_dedup import dedup_substrings
from pingscape.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; rows that repeat an id with its text share one decision."""
    scored = toxicity(spark, docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.filter("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; of rows that repeat it, one."""
    found = near_duplicates(spark, docs)
    once = without(docs, found.filter("not kept"))
    keys = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    if docs.select(*keys).groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        return once
    return once.dropDuplicates(["doc_id", "text"])  # rows that repeat an id with its text are copies too


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; a document of which nothing is left goes.

    Where something was removed, the words left stand with one space between; other texts keep their white space.
    Rows that repeat a text lose all of its windows of 35 words.
    """
    cut = dedup_substrings(spark, docs, keep=tuple(docs.columns))
    left = cut.filter("n_removed = 0 or n_removed < n_words")
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("rest.text"))}
    new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars")).cast("long")
    return left.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; rows that repeat an id with its text share one decision."""
    found = contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048 tokens; every row is packed, repeated ones again, a null text as its end."""
    return pack(spark, docs, tokenizer_path(), size=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Training a classifier, hashing and tokenizing have no SQL; the tests follow the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
