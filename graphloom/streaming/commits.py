"""File metrics kept up to date from a stream of commits.

The recency weight is exponential, so an old sum moves to a new date by one factor: each micro-batch merges
its own sums into the table at a common date. One row per file is the whole state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.history import HALF_LIFE_DAYS

STATE = "path string, commits bigint, additions bigint, deletions bigint, recency double, as_of timestamp, last_changed timestamp"


def merge_metrics(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State plus a batch of (path, ts, additions, deletions): sums moved to the newest date of both."""
    new = batch.select("path", F.lit(1).cast("bigint").alias("commits"), F.col("additions").cast("bigint").alias("additions"), F.col("deletions").cast("bigint").alias("deletions"), F.lit(1.0).alias("recency"), F.col("ts").alias("as_of"), F.col("ts").alias("last_changed"))
    rows = state.unionByName(new)
    newest = rows.groupBy("path").agg(F.max("as_of").alias("to"))
    days = (F.unix_micros("to") - F.unix_micros("as_of")) / 86_400_000_000.0
    moved = rows.join(newest, "path").withColumn("recency", F.col("recency") * F.exp(-F.log(F.lit(2.0)) * days / HALF_LIFE_DAYS))
    return moved.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("commits", "additions", "deletions", "recency")], F.max("to").alias("as_of"), F.max("last_changed").alias("last_changed"))


def maintain(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` (two Parquet folders used in turn) merged with every micro-batch of ``stream``; replays of a batch change nothing."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        source, target = f"{table}/{(number + 1) % 2}", f"{table}/{number % 2}"
        state = spark.createDataFrame([], STATE) if number == 0 else spark.read.schema(STATE).parquet(source)
        merge_metrics(state, batch).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
