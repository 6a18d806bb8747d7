"""Windowed counts and visits of an event stream; the same functions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exact, money_of


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type. On a stream, rows later than ``late`` behind are dropped
    and an hour is emitted once it is closed; on a batch the watermark has no effect."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = timed.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def run_once(spark: SparkSession, folder: str, schema, out: str, state: str) -> None:
    """Read what is new in ``folder``, append closed hours to ``out``, and stop."""
    source = spark.readStream.schema(schema).parquet(folder)
    query = hourly_counts(source).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()


def without_repeats(events: DataFrame, identity: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, with ``ts`` as a timestamp. On a stream an identity is remembered for
    ``late`` after its time, so that state is bounded; a repeat that comes after that is late
    itself and dropped as such. Rows with a null time have no window and go."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    if events.isStreaming:
        return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([identity])
    return timed.dropDuplicates([identity])


def user_visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, began, ended, n, value) of each visit: distinct events of a user no more than
    ``gap`` apart. A stream emits a visit once, when no event that is in time can extend it.

    State holds a row for each open visit, not its events: a task's rows are merged before
    they are shuffled, if the session has ``sessionWindow.merge.sessions.in.local.partition`` on.
    """
    distinct = without_repeats(events, late=late).select("user_id", "ts", "value")
    window = F.session_window("ts", gap)
    found = distinct.groupBy("user_id", window).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.sum(exact(F.col("value"))).alias("value"))
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("user_id", naive("began"), naive("ended"), "n", money_of(F.col("value")).alias("value"))


def into_batches(out: str):
    """A sink for ``foreachBatch``: each micro-batch overwrites its own folder below ``out``, so
    one that is run again after a lost driver leaves no rows twice."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def follow_visits(spark: SparkSession, folder: str, schema, out: str, state: str) -> None:
    """Read what is new in ``folder``, add the visits that are closed by it to ``out``, and stop."""
    source = spark.readStream.schema(schema).parquet(folder)
    query = user_visits(source).writeStream.foreachBatch(into_batches(out)).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
