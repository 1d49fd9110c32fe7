"""Streams of view events: daily counters, sliding trends, sessions, and dedup by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.session import drop_stored, scratch_dir

LATE = "1 day"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = 1) -> DataFrame:
    """New Parquet files of a folder, in batches of so many files; None: all that are there at once, so that none is late."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = LATE) -> DataFrame:
    """Views of each case and day; events later than the watermark are dropped."""
    seen = _timed(events).where("event_type = 'view'").withWatermark("ts", late)
    return seen.groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("case_id")).agg(F.count("*").alias("view_count")).select("case_id", F.to_date("w.start").alias("counter_date"), "view_count")


def sliding(events: DataFrame, late: str = LATE) -> DataFrame:
    """Views of each case over seven days, every day."""
    seen = _timed(events).where("event_type = 'view'").withWatermark("ts", late)
    return seen.groupBy(F.window("ts", "7 days", "1 day").alias("w"), F.col("user_id").alias("case_id")).agg(F.count("*").alias("views")).select("case_id", F.to_date("w.start").alias("since"), "views")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of a user's events with pauses under the gap."""
    timed = _timed(events).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "events")


def once(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark (a view counts once a session and case)."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: State beyond memory goes to disk.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all there is now, and return the result table.

    The result is a table of the shared folder, a part for each batch, written by the executors;
    in complete mode the last batch's part is the table and replaces the one before.
    """
    spark = stream.sparkSession
    root, batches = f"{scratch_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}", []

    def write(rows: DataFrame, batch: int) -> None:
        path = f"{root}/{batch}"
        rows.write.mode("overwrite").parquet(path)
        others = [b for b in batches if b != path]
        if mode == "complete":
            drop_stored(spark, *others)
            others = []
        batches[:] = [*others, path]

    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*batches) if batches else spark.createDataFrame([], stream.schema)


def fresh(beats: DataFrame, now, most_seconds: int) -> DataFrame:
    """Workers with a flag whether their last heartbeat is recent; none or a broken one isn't."""
    stamp = F.try_to_timestamp("beat")
    return beats.withColumn("fresh", F.coalesce((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(stamp)) <= most_seconds, F.lit(False)))
