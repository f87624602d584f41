"""Where iterative jobs cut their lineage, and tables that several steps of a job store once."""

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a scratch folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pingscape-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Stored(NamedTuple):
    """A stored table with the rows and the length of the content that its writing counted."""

    table: DataFrame
    rows: int
    length: int


_SCOPE: list[tuple[DataFrame, Stored]] | None = None
_COUNTED: WeakKeyDictionary[DataFrame, Stored] = WeakKeyDictionary()


@contextmanager
def stored_once() -> Iterator[None]:
    """Inside, a table that has been stored and counted already, by the identity of its plan, is taken as it was stored.

    For one job whose inputs do not change meanwhile; what was stored is forgotten at the end, and its files go when
    nothing refers to them (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    global _SCOPE
    outer = _SCOPE
    _SCOPE = [] if outer is None else outer
    try:
        yield
    finally:
        _SCOPE = outer


def stored_and_counted(df: DataFrame) -> Stored:
    """Store a table and count its rows and the length of their content as text in the same job.

    What this function has stored is not stored again.
    """
    if df in _COUNTED:
        return _COUNTED[df]
    for given, found in _SCOPE or ():
        if given.sparkSession is df.sparkSession and given.columns == df.columns and given.sameSemantics(df):
            return found
    seen = Observation()
    length = F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), length.alias("length")))
    found = _COUNTED[table] = Stored(table, seen.get["rows"], seen.get["length"] or 0)
    if _SCOPE is not None:
        _SCOPE.append((df, found))
    return found
