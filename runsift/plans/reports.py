"""Projections and aggregates of the execution summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.operators.blocks import EXEC

# Metric names in output order; those after the first five vanish when zero.
METRIC_NAMES = (
    "tests_passed",
    "tests_failed",
    "warnings",
    "errors",
    "duration_seconds",
    "max_ram_mb",
    "avg_cpu_percent",
    "test_files",
    "modules_compiled",
    "bundle_size",
    "artifact_size",
    "original_bytes",
    "compressed_bytes",
    "savings_percentage",
)
ALWAYS_SHOWN = 5
TEXT_METRICS = ("bundle_size", "artifact_size")


def _unless_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def metrics(omit_zero: bool = True) -> Column:
    """Metrics as a struct. With `omit_zero`, zero values are null, and `to_json` drops them."""
    columns = []
    for i, name in enumerate(METRIC_NAMES):
        value = F.col(name)
        if omit_zero and i >= ALWAYS_SHOWN:
            value = F.nullif(value, F.lit("") if name in TEXT_METRICS else F.lit(0))
        columns.append(value.alias(name))
    return F.struct(*columns)


def error_intel() -> Column:
    intel = F.col("error_intel")
    return F.when(
        intel.isNotNull(),
        F.struct(
            intel["root_cause"].alias("root_cause"),
            intel["error_type"].alias("error_type"),
            intel["context"].alias("context"),
            _unless_empty(intel["correlated_changes"]).alias("correlated_changes"),
        ),
    )


def test_report(summary: DataFrame) -> DataFrame:
    return summary.select(EXEC, "status", "tests_passed", "tests_failed")


def build_report(summary: DataFrame) -> DataFrame:
    return summary.select(EXEC, "status", "summary", metrics().alias("metrics"))


def agent_json(summary: DataFrame) -> DataFrame:
    """Compact JSON for a program that reads the result: digest, metrics, errors (null when there
    are none), sizes of what was built, and the full log's path on failure."""
    errors = F.coalesce(F.to_json(error_intel()), F.lit("null"))
    sizes = F.to_json(
        F.struct(
            F.nullif("artifact_size", F.lit("")).alias("artifact_size"),
            F.nullif("bundle_size", F.lit("")).alias("bundle_size"),
        )
    )
    fallback = F.when(
        (F.col("status") == "failure") & F.col("raw_log_path").isNotNull(),
        F.concat(F.lit(',"raw_log_fallback":'), _json_text(F.col("raw_log_path"))),
    )
    body = F.concat(
        F.lit('{"artifacts":'),
        sizes,
        F.lit(',"compressed_context":'),
        _json_text(F.col("compressed_context")),
        F.lit(',"errors":'),
        errors,
        F.lit(',"metrics":'),
        F.to_json(metrics()),
        F.coalesce(fallback, F.lit("")),
        F.lit("}"),
    )
    return summary.select(EXEC, body.alias("json"))


def _json_text(value: Column) -> Column:
    """A JSON string literal: the value of a one-field object, cut out of it."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def summary_json(summary: DataFrame) -> DataFrame:
    """The full record; empty optional fields are left out. `event_count` stands for the list of
    events, which are rows of `all_tool_events`; `separator`, in records of `execution_records`, says
    that the text goes on with them (see `summary_parts`)."""
    record = F.struct(
        F.col(EXEC).cast("string").alias("execution_id"),
        "tool",
        "command",
        "status",
        "summary",
        F.nullif("event_count", F.lit(0)).alias("event_count"),
        "separator",
        metrics().alias("metrics"),
        error_intel().alias("error_intel"),
        _unless_empty(F.col("suggestions")).alias("suggestions"),
        "artifact_path",
        "raw_log_path",
        F.nullif("compressed_context", F.lit("")).alias("compressed_context"),
        "timestamp",
    )
    return summary.select(EXEC, F.to_json(record).alias("json"))


#: Places of the parts of a JSON record: what stands before the listed events of the summary, behind
#: them, and behind the list of events.
_CLOSING, _LIST, _REST = 1 << 40, (1 << 40) + 1, 1 << 62


def record_json_parts(summary: DataFrame, events: DataFrame, rows_per_part: int = 1 << 12) -> DataFrame:
    """The full record as JSON text in parts: (exec_id, part_no, json), whose concatenation in order
    of part_no is one object with all events, in the field order of `summary_json`. Events are
    listed as they are and, for type checks and version control, inside the summary text as well,
    before its root cause. No part holds more than `rows_per_part` line numbers of events.

    `summary` is what `execution_records` gives and should be stored; `events` is what
    `all_tool_events` gives."""
    quoted = lambda c: F.substring(_json_text(c), F.lit(2), F.length(_json_text(c)) - 2)
    cause = F.concat(F.lit("\n\nRoot cause:\n"), F.col("error_intel.root_cause"))
    listing = F.col("separator").isNotNull()
    closing = F.when(listing & F.col("error_intel").isNotNull(), cause)
    head = F.when(closing.isNotNull(), F.expr("substring(summary, 1, length(summary) - length(_closing))")).otherwise(F.col("summary"))
    rows = summary.withColumn("_closing", closing)
    start = F.concat(
        F.lit('{"execution_id":'), _json_text(F.col(EXEC).cast("string")),
        *[F.concat(F.lit(f',"{name}":'), _json_text(F.col(name))) for name in ("tool", "command", "status")],
        F.lit(',"summary":"'), quoted(head),
    )
    rest = F.to_json(
        F.struct(
            metrics().alias("metrics"),
            error_intel().alias("error_intel"),
            _unless_empty(F.col("suggestions")).alias("suggestions"),
            "artifact_path",
            "raw_log_path",
            F.nullif("compressed_context", F.lit("")).alias("compressed_context"),
            "timestamp",
        )
    )
    frame = rows.select(
        EXEC,
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("part_no"), start.alias("json")),
                F.struct(F.lit(_CLOSING).alias("part_no"), F.concat(F.coalesce(quoted(F.col("_closing")), F.lit("")), F.lit('"')).alias("json")),
                F.struct(
                    F.lit(_REST).alias("part_no"),
                    F.concat(F.when(F.col("event_count") > 0, F.lit("],")).otherwise(F.lit(",")), F.substring(rest, F.lit(2), F.length(rest))).alias("json"),
                ),
            )
        ).alias("_p"),
    ).select(EXEC, "_p.part_no", "_p.json")

    # Events by ranges of line numbers; which range is the first follows from the numbers alone.
    numbered = events.withColumn("_part", F.call_function("div", F.col("line_no"), F.lit(rows_per_part)))
    firsts = numbered.groupBy(EXEC).agg(F.min("_part").alias("_first"))
    keys = (
        numbered.select(EXEC, "_part").distinct().join(firsts, EXEC).join(summary.select(EXEC, "separator"), EXEC)
    )
    pieces = numbered.groupBy(EXEC, "_part").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "step", "event"))).getField("event").alias("_events")
    ).join(keys, [EXEC, "_part"])
    is_first = F.col("_part") == F.col("_first")
    listed = F.to_json("_events")
    in_list = F.concat(
        F.when(is_first, F.lit(',"important_events":[')).otherwise(F.lit(",")), F.substring(listed, F.lit(2), F.length(listed) - 2)
    )
    joined = F.concat(F.when(is_first, F.lit("")).otherwise(F.col("separator")), F.expr("array_join(_events, separator)"))
    body = pieces.select(
        EXEC,
        F.explode(
            F.filter(
                F.array(
                    F.struct((F.col("_part") + F.lit(_LIST)).alias("part_no"), in_list.alias("json")),
                    F.when(F.col("separator").isNotNull(), F.struct((F.col("_part") + 1).alias("part_no"), quoted(joined).alias("json"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("_p"),
    ).select(EXEC, F.col("_p.part_no").cast("bigint").alias("part_no"), "_p.json")
    return frame.unionByName(body)


def engine_counters(executions: DataFrame) -> DataFrame:
    """Totals; a failure here is a non-zero exit code only."""
    return executions.agg(
        F.count(F.lit(1)).alias("commands_executed"),
        F.count_if(F.col("exit_code") != 0).alias("command_failures"),
    )


def savings_by_tool(summary: DataFrame) -> DataFrame:
    return summary.groupBy("tool").agg(
        F.count(F.lit(1)).alias("executions"),
        F.round(F.avg("original_bytes"), 4).alias("avg_original_bytes"),
        F.round(F.avg("compressed_bytes"), 4).alias("avg_digest_bytes"),
        F.round(F.avg(F.round("savings_percentage", 6)), 4).alias("avg_reduction"),
    )
