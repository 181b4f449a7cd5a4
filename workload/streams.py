"""Streaming queries over the log view, replayed in time order and run to completion."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from runsift.operators.blocks import number_rows
from runsift.plans.executions import execution_records
from runsift.session import ROCKSDB, STATE_STORE
from runsift.session import scratch_path as scratch
from runsift.streaming import jobs
from workload import views

PERIODS = 4
TIMEOUT_SECONDS = 29 * 24 * 3600
HEARTBEAT_SECONDS = 24 * 3600
#: Lines of a file of arrivals, and files that come together, at most.
FILE_ROWS, MOST_FILES = 80_000, 8
PARTITIONS = "spark.sql.shuffle.partitions"
LINE_SCHEMA = "exec_id BIGINT, line_no BIGINT, line STRING, ts TIMESTAMP, exit_code INT"


class Arrivals(NamedTuple):
    """A folder of files, and how many of them make a micro-batch."""

    path: str
    files: int


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines with their time, then one exit event per execution."""
    times = views.table(spark, sf, "events").select("event_id", "ts")
    sliced = F.floor(F.col("event_id") / views.EVENT_SLICE)
    lines = number_rows(
        views.event_lines(spark, sf).join(times, "event_id"),
        "exec_id",
        [sliced],
        ["event_id"],
    ).select("exec_id", "line_no", "line", "ts", F.lit(None).cast("int").alias("exit_code"))
    exits = views.executions(spark, sf).select(
        "exec_id",
        F.lit(None).cast("bigint").alias("line_no"),
        F.lit(None).cast("string").alias("line"),
        F.col("end_ts").alias("ts"),
        "exit_code",
    )
    return lines.unionByName(exits)


def replay(spark: SparkSession, sf: str) -> Arrivals:
    """Files whose order of arrival is the order of event time: those of a stretch of time come
    together, so that no event is older than what came in an earlier micro-batch. A period is one
    stretch, or several if it has very many events."""
    staged, path = scratch(spark, "staged"), scratch(spark, "arrivals")
    _events(spark, sf).write.parquet(staged)
    events = spark.read.schema(LINE_SCHEMA).parquet(staged)
    lo, hi, rows = events.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts")), F.count("*")).first()
    stretches = PERIODS * max(1, math.ceil(rows / (PERIODS * MOST_FILES * FILE_ROWS)))
    stretch = F.floor((F.unix_seconds("ts") - lo) * stretches / (hi - lo + 1))
    sizes = dict(events.groupBy(stretch.alias("n")).count().collect())
    # No file may be empty: none would be written, and its place would go to one of the next stretch.
    least = min(sizes.get(n, 0) for n in range(stretches))
    files = max(1, min(MOST_FILES, rows // (stretches * FILE_ROWS // 4))) if least >= FILE_ROWS // 4 else 1
    for n in range(stretches):
        events.filter(stretch == n).repartition(files).write.mode("append").parquet(path)
    return Arrivals(path, files)


def arriving(spark: SparkSession, arrivals: Arrivals) -> DataFrame:
    return (
        spark.readStream.schema(LINE_SCHEMA)
        .option("maxFilesPerTrigger", arrivals.files)
        .parquet(arrivals.path)
    )


def run(spark: SparkSession, writer: DataStreamWriter) -> None:
    # These queries run in sessions that are not ours: the options are put back. Each partition opens
    # and commits its state in every micro-batch, so that there are no more of them than cores.
    parts = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    options = {STATE_STORE: ROCKSDB, PARTITIONS: str(parts)}
    before = {name: spark.conf.get(name) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        query = (
            writer.option("checkpointLocation", scratch(spark, "progress"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    run(spark, stream.writeStream.format("parquet").option("path", path).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(path)


def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    lines = arriving(spark, replay(spark, sf)).filter(F.col("line").isNotNull())
    return to_table(spark, jobs.clean_stream(lines, block_rows=16), "cleaned")


def stream_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The record of every execution that closes, by its exit or by the timeout."""
    arrivals, out = replay(spark, sf), scratch(spark, "summaries")
    commands = views.executions(spark, sf).select("exec_id", "command_line", "cmd")

    def summarize(closed: DataFrame, lines: DataFrame) -> DataFrame:
        summary = execution_records(closed.join(commands, "exec_id"), lines)
        return summary.select(
            F.col("exec_id").cast("string").alias("execution_id"), "command", "status", "summary"
        )

    logs = jobs.closed_logs(arriving(spark, arrivals), TIMEOUT_SECONDS, block_rows=64)
    run(spark, jobs.summary_writer(logs, summarize, out))
    schema = "execution_id STRING, command STRING, status STRING, summary STRING"
    return spark.read.schema(schema).parquet(f"{out}/batch_id=*")


def stream_heartbeat(spark: SparkSession, sf: str) -> DataFrame:
    lines = arriving(spark, replay(spark, sf)).filter(F.col("line").isNotNull())
    beats = to_table(spark, jobs.heartbeats(lines, HEARTBEAT_SECONDS), "heartbeats")
    return beats.select("exec_id", F.unix_micros("ts").alias("at_us"), "since_ms")


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of the running totals."""
    events = arriving(spark, replay(spark, sf)).filter(F.col("exit_code").isNotNull())
    path = scratch(spark, "counters")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run(spark, jobs.counters(events).writeStream.foreachBatch(keep).outputMode("complete"))
    return spark.read.parquet(path)


def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    from runsift.sources.history import read_history

    source, out = scratch(spark, "finished"), scratch(spark, "history")
    views.history(spark, sf).drop("ts").write.json(source)
    arrivals = spark.readStream.schema(
        "execution_id STRING, command STRING, status STRING, summary STRING"
    ).json(source)
    run(spark, jobs.history_writer(arrivals, out, "finished"))
    # The same stream again from the start: nothing is added.
    run(spark, jobs.history_writer(arrivals, out, "finished"))
    return read_history(spark, out)
