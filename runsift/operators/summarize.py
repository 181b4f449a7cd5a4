"""Generic summary of a reduced log, for executions whose tool is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.functions.text import contains_any, matches
from runsift.operators.blocks import EXEC
from runsift.operators.reduce import IDX

EVENTS = 10


def semantic_summary(rows: DataFrame) -> DataFrame:
    """Status, text, counters and first events per execution.

    `rows` is the output of a reduction, so an execution has a bounded number of rows and its
    events may be collected in the one aggregate.
    """
    low = F.lower("line")
    # None of these words has a letter with a special case folding: lower case does as well.
    sign = contains_any(low, "error", "failed", "panic")
    harmless = matches(low, r"0\s+errors?") | contains_any(low, "0 failures", "0 failed")
    flagged = (
        rows.select(EXEC, IDX, "line", low.alias("_low"), sign.alias("_sign"))
        .withColumn("_skip", F.col("_sign") & harmless)
        .filter(~F.col("_skip"))
    )
    low = F.col("_low")
    succeeded = contains_any(low, "build succeeded", "compiled successfully")
    completed = succeeded | contains_any(low, "build complete", "build finished", "dist/")
    tested = low.contains("test") & contains_any(low, "completed", "passed", "finished")
    events = F.sort_array(F.collect_list(F.when(F.col("_sign"), F.struct(IDX, "line"))))
    return flagged.groupBy(EXEC).agg(
        F.count_if("_sign").alias("errors"),
        F.count_if(low.contains("warn")).alias("warnings"),
        F.count_if(F.col("_sign") & low.contains("error")).alias("_is_error"),
        F.count_if(succeeded).alias("_succeeded"),
        F.count_if(completed).alias("_completed"),
        F.count_if(tested).alias("_tested"),
        F.slice(events, 1, EVENTS).getField("line").alias("events"),
    )


def with_verdict(flags: DataFrame) -> DataFrame:
    """Text ladder over the flags; an execution without any counted line is a success."""
    ladder = (
        F.when((F.col("_is_error") > 0) & (F.col("_completed") > 0), F.lit("✗ Completed with errors"))
        .when(F.col("_is_error") > 0, F.lit("✗ Build failed"))
        .when(F.col("errors") > 0, F.lit("✗ Execution failed"))
        .when(F.col("_succeeded") > 0, F.lit("✓ Build succeeded"))
        .when(F.col("_completed") > 0, F.lit("✓ Build completed"))
        .when(F.col("_tested") > 0, F.lit("✓ Tests completed"))
        .when(F.col("warnings") > 0, F.lit("⚠ Completed with warnings"))
        .otherwise(F.lit("✓ Execution successful"))
    )
    return flags.select(
        EXEC,
        F.when(F.col("errors") > 0, F.lit("failure")).otherwise(F.lit("success")).alias("status"),
        ladder.alias("summary"),
        "errors",
        "warnings",
        "events",
    )


def summarize_rows(rows: DataFrame, executions: DataFrame | None = None) -> DataFrame:
    """`semantic_summary` with its verdict, for each execution of `rows` or of `executions`."""
    keys = (executions if executions is not None else rows.select(EXEC).distinct()).select(EXEC)
    zero = ["errors", "warnings", "_is_error", "_succeeded", "_completed", "_tested"]
    return with_verdict(
        keys.join(semantic_summary(rows), EXEC, "left")
        .fillna(0, zero)
        .withColumn("events", F.coalesce("events", F.array().cast("array<string>")))
    )
