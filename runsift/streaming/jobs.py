"""Streaming jobs over log lines and exit events.

The session must keep streaming state in RocksDB (`runsift.session.ROCKSDB`), and the Python
workers must find this package: `--py-files` on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from runsift.operators.blocks import EXEC, LINE_NO, block_of
from runsift.operators.clean import is_progress, normalize
from runsift.sources.history import FIELDS
from runsift.session import as_table
from runsift.sources.sinks import append_history
from runsift.streaming.stateful import Borders, DedupeBlocks, Heartbeat, HoldLines, LastNumbers, RunLifecycle

#: The block of a line; names that begin otherwise do not reach the Python side.
BLOCK = "block"
#: Groups of executions, or of blocks, that go to Python together. Checkpoints hold their numbers.
GROUPS = 64
DEFAULT_TIMEOUT_SECONDS = 600
HEARTBEAT_SECONDS = 5


def _expiry(keep_seconds: int | None) -> tuple[int | None, str]:
    """Milliseconds that a value is kept, and the time mode. A stream that runs on should have an
    expiry, or each execution leaves a value behind. Runs to the end of the input (trigger
    availableNow) take None: with processing time they would wait for expiries without end."""
    return (None, "None") if keep_seconds is None else (keep_seconds * 1000, "ProcessingTime")


def _key_type(df: DataFrame) -> str:
    return df.schema[EXEC].dataType.simpleString()


def _who() -> Column:
    """The execution as a text: '' for none, else '=' and its name."""
    return F.coalesce(F.concat(F.lit("="), F.col(EXEC).cast("string")), F.lit("")).alias("who")


def _named(kind: str) -> Column:
    return F.when(F.col("who") != "", F.substring(F.col("who"), 2, 1 << 30).cast(kind)).alias(EXEC)


def _group(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(GROUPS)).cast("int")


def clean_stream(lines: DataFrame, keep_seconds: int | None = None, block_rows: int | None = None) -> DataFrame:
    """exec_id, line_no, line, late. Lines behind the last number that their execution had in earlier
    micro-batches, or without a number, are not merged; they come out with `late` set, for a side
    table.

    Text is spread by execution and block of line numbers. What an execution needs as a whole goes
    through one key of its own: its numbers before, and two lines for each block behind."""
    keep_ms, mode = _expiry(keep_seconds)
    number = F.col(LINE_NO)
    text = lines.select(
        _who(), block_of(number, block_rows).alias(BLOCK), F.coalesce(number, F.lit(0).cast("bigint")).alias("number"),
        number.isNotNull().alias("has"), normalize(F.col("line")).alias("line"),
    ).filter(F.col("line") != "")
    floors = (
        text.select("who", BLOCK, "number", "has")
        .withColumn("part", _group("who"))
        .groupBy("part")
        .transformWithStateInPandas(LastNumbers(keep_ms), f"who string, {BLOCK} bigint, floor bigint", "Append", mode)
    )
    told = text.withColumn("floor", F.lit(LastNumbers.NONE)).unionByName(
        floors.select(
            "who", BLOCK, F.lit(0).cast("bigint").alias("number"), F.lit(False).alias("has"), F.lit(None).cast("string").alias("line"), "floor"
        )
    )
    row = "number bigint, has boolean, line string, late boolean"
    deduped = told.withColumn("part", _group("who", BLOCK)).groupBy("part").transformWithStateInPandas(
        DedupeBlocks(keep_ms), f"who string, {BLOCK} bigint, {row}, kind int", "Append", mode
    )
    part = F.when(F.col("kind") == DedupeBlocks.ROW, _group("who", BLOCK) + GROUPS).otherwise(_group("who"))
    settled = deduped.withColumn("part", part).groupBy("part").transformWithStateInPandas(
        Borders(keep_ms, GROUPS), f"who string, {row}", "Append", mode
    )
    kept = settled.filter(~is_progress(F.col("line")))
    return kept.select(_named(_key_type(lines)), F.when(F.col("has"), F.col("number")).alias(LINE_NO), "line", "late")


def _closings(events: DataFrame, timeout_seconds: int, delay: str) -> DataFrame:
    number = F.col(LINE_NO) if LINE_NO in events.columns else F.lit(None).cast("bigint").alias(LINE_NO)
    return (
        events.select(_who(), "ts", F.unix_micros("ts").alias("at"), "exit_code", number)
        .withColumn("part", _group("who"))
        .withWatermark("ts", delay)
        .groupBy("part")
        .transformWithStateInPandas(
            RunLifecycle(timeout_seconds * 1_000_000),
            "who string, start_us bigint, end_us bigint, exit_code int, timed_out boolean, last_no bigint",
            "Append",
            "EventTime",
        )
    )


def _times(closed: DataFrame, name: str | Column = EXEC) -> DataFrame:
    return closed.select(
        name,
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("end_us").alias("end_ts"),
        "exit_code",
        "timed_out",
    )


def closings(
    events: DataFrame,
    timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS,
    delay: str = "0 seconds",
) -> DataFrame:
    """Ends of executions from events (exec_id, ts, exit_code; exit_code null on log lines).
    Only narrow columns go through the state."""
    return _times(_closings(events, timeout_seconds, delay), _named(_key_type(events)))


def closed_logs(
    events: DataFrame,
    timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS,
    delay: str = "0 seconds",
    block_rows: int | None = None,
) -> DataFrame:
    """Closings together with the lines of exactly the executions that close, from one stream of
    events (exec_id, line_no, line, ts, exit_code; exit events have no line).

    Lines wait in keyed state, by execution and block of line numbers, so that a long execution is
    spread; a closing goes to every block of its execution, and each gives its lines out. Nothing
    that has landed is read again. A closing is the row without a line number."""
    block = block_of(F.col(LINE_NO), block_rows).alias(BLOCK)
    empty = {c: F.lit(None).cast(t) for c, t in (("start_us", "bigint"), ("end_us", "bigint"), ("exit_code", "int"), ("timed_out", "boolean"))}
    lines = events.filter(F.col(LINE_NO).isNotNull()).select(
        _who(), block, LINE_NO, "line", F.unix_micros("ts").alias("at"), *[v.alias(c) for c, v in empty.items()]
    )
    last = block_of(F.greatest(F.col("last_no"), F.lit(0).cast("bigint")), block_rows)
    ends = _closings(events, timeout_seconds, delay).select(
        "who",
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(BLOCK),
        F.lit(None).cast("bigint").alias(LINE_NO),
        F.lit(None).cast("string").alias("line"),
        F.lit(None).cast("bigint").alias("at"),
        *empty,
    )
    closed = (
        lines.unionByName(ends)
        .withColumn("part", _group("who", BLOCK))
        .groupBy("part")
        .transformWithStateInPandas(
            HoldLines(),
            f"who string, {LINE_NO} bigint, line string, start_us bigint, end_us bigint, exit_code int, timed_out boolean",
            "Append",
            "None",
        )
    )
    return closed.select(_named(_key_type(events)), LINE_NO, "line", "start_us", "end_us", "exit_code", "timed_out")


def heartbeats(
    lines: DataFrame, every_seconds: int = HEARTBEAT_SECONDS, keep_seconds: int | None = None
) -> DataFrame:
    """exec_id, ts, since_ms of every heartbeat of long-running executions."""
    keep_ms, mode = _expiry(None if keep_seconds is None else max(keep_seconds, 2 * every_seconds))
    beats = (
        lines.select(_who(), F.unix_micros("ts").alias("at"))
        .withColumn("part", _group("who"))
        .groupBy("part")
        .transformWithStateInPandas(
            Heartbeat(every_seconds * 1_000_000, keep_ms), "who string, at bigint, since_ms bigint", "Append", mode
        )
    )
    return beats.select(_named(_key_type(lines)), F.timestamp_micros("at").alias("ts"), "since_ms")


def counters(closed: DataFrame) -> DataFrame:
    """Running totals over closed executions."""
    return closed.groupBy().agg(
        F.count(F.lit(1)).alias("commands_executed"),
        F.count_if(F.col("exit_code") != 0).alias("command_failures"),
    )


def summary_writer(
    logs: DataFrame,
    summarize: Callable[[DataFrame, DataFrame], DataFrame],
    path: str,
) -> DataStreamWriter:
    """Write one summary per closed execution of `closed_logs`. `summarize` is the batch plan: it
    gets the closings of a micro-batch and their lines. A replayed micro-batch overwrites its own
    folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The plan reads closings and lines several times; the state must run once.
        once = as_table(batch, "closed")
        ends = _times(once.filter(F.col(LINE_NO).isNull()))
        if not ends.isEmpty():
            summary = summarize(ends, once.filter(F.col(LINE_NO).isNotNull()).select(EXEC, LINE_NO, "line"))
            summary.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return logs.writeStream.foreachBatch(write).outputMode("append")


def history_writer(summaries: DataFrame, path: str, source: str) -> DataStreamWriter:
    """Append {execution_id, command, status, summary} as JSON lines, each micro-batch once: a
    batch of the history for each, named after `source`, so that one which is replayed, by this
    query or by one that starts over from its checkpoint, adds nothing. Batch jobs may append to
    the same history."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_history(batch, path, f"{source}-{batch_id}")

    return summaries.select(*FIELDS).writeStream.foreachBatch(write).outputMode("append")
