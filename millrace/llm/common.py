"""What the corpus operators share: scratch tables and names that clash with nothing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch between Spark and Python.
ARROW_BYTES = 2 << 20
#: Tables are broadcast up to this many rows, and bytes as they are held in memory.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Spark's bound of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_local: list[str] = []
_tables: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir.

    Where that is unset and Spark runs in one process, as in tests, a folder of our own
    that goes when Python ends; on a cluster without it, an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written once below the shared folder and read from there.

    This cuts the lineage: a lost executor costs a read of the table, and what is not
    deterministic (partition numbers, samples) is settled. Spark also knows the table's
    size afterwards, so it broadcasts it only if it is below the session's threshold.
    Tables stay, as results are read lazily, until ``removed_after`` or ``remove_scratch``
    removes them; a ``lasting`` one stays past the former.
    """
    path = fresh_path(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path of its own below the shared folder."""
    path = f"{scratch(spark)}/millrace-{uuid.uuid4().hex}/{name}"
    if not lasting:
        _tables.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a table that has a ``fresh_path``, with the folder made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_scratch(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch tables that this process wrote, from the ``since``-th on; results
    that read them can't be read any more."""
    while len(_tables) > since:
        remove_path(spark, _tables.pop())


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are removed at the end; write what is to stay as ``lasting``."""
    since = len(_tables)
    try:
        yield
    finally:
        remove_scratch(spark, since)


def chained(first: DataFrame, steps: Iterable[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """What the last step makes, each step's rows being written and read again by the next.

    A step's scratch tables go when its own table stands, and that goes when the next one
    does: at any time there are two such tables at most, and one is left.
    """
    spark, table, last = first.sparkSession, first, None
    for name, step in steps:
        with removed_after(spark):
            path = fresh_path(spark, name, lasting=True)
            made = step(table)
            made.write.parquet(path)
            table = spark.read.schema(made.schema).parquet(path)
        if last:
            remove_path(spark, last)
        last = path
    return table


def bytes_of(size: str) -> int:
    """A size as Spark's settings have it: a number with k, m, g, t or p, and b, or neither."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", str(size).lower())
    if not found:
        raise ValueError(f"no size in bytes: {size}")
    return int(found[1]) << 10 * (" kmgtp".index(found[2] or " "))


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in Arrow batches of ARROW_BYTES at most.

    Spark's own bound of 64 MB is large for whole texts: both sides of every task hold a
    batch and what is made of it. It stays for the session, since Spark reads it when a
    result is run, after the operator has returned; a smaller bound is left alone.
    """
    if not 0 < bytes_of(spark.conf.get(BATCH)) <= ARROW_BYTES:
        spark.conf.set(BATCH, str(ARROW_BYTES))


def settled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written as one table, which stays; its other scratch tables
    are removed, and the session's bound of batches is what it was."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = spark.conf.get(BATCH)
        try:
            with removed_after(spark):
                return written(query(spark, sf_dir), query.__name__, lasting=True)
        finally:
            spark.conf.set(BATCH, before)

    return run


def bytes_in(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory, whatever its type."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("bigint") + 16
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(16).cast("bigint"), lambda total, x: total + bytes_in(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = bytes_in(F.map_keys(value), T.ArrayType(kind.keyType)) + bytes_in(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((bytes_in(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    else:
        size = F.lit(8).cast("bigint")
    return F.coalesce(size, F.lit(8))


def sized(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast only if it has BROADCAST_ROWS rows and BROADCAST_BYTES
    bytes at most, as counted over its values; a larger one is joined as Spark sees fit."""
    size = sum((bytes_in(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields), F.lit(16).cast("bigint"))
    found = rows.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).first()
    return F.broadcast(rows) if found["rows"] <= BROADCAST_ROWS and (found["bytes"] or 0) <= BROADCAST_BYTES else rows


def source_partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def whole_text(text: str = "text") -> Column:
    """A text column, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def n_words(text: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")
