"""Line cleaning: escapes, timestamps, white space, blanks, adjacent repeats, progress noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.functions.text import re2, startswith_any, trim
from runsift.operators.blocks import BLOCK, EXEC, LINE_NO, in_block, into_blocks, previous_line

# Terminal escapes, timestamp prefix and progress prefixes to remove.
ANSI_PATTERN = (
    r"[\x1B\x9B][[\]()#;?]*"
    r"(?:(?:(?:[a-zA-Z\d]*(?:;[a-zA-Z\d]*)*)?\x07)"
    r"|(?:(?:\d{1,4}(?:;\d{0,4})*)?[\dA-PRZcf-ntqry=><~]))"
)
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[\.,]\d{3}Z?\s*"
PROGRESS_PREFIXES = ("Downloading ", "Progress: ")
SAMPLE_LINES = 10


def strip_ansi(line: Column) -> Column:
    # The byte test keeps the regex engine away from the many lines without an escape.
    escaped = line.contains("\x1b") | line.contains("\x9b")
    return F.when(escaped, F.regexp_replace(line, re2(ANSI_PATTERN), "")).otherwise(line)


def strip_timestamp(line: Column) -> Column:
    dated = F.substring(line, 5, 1) == "-"
    return F.when(dated, F.regexp_replace(line, re2(TIMESTAMP_PATTERN), "")).otherwise(line)


def normalize(line: Column) -> Column:
    return trim(strip_timestamp(strip_ansi(line)))


def is_progress(line: Column) -> Column:
    return startswith_any(line, *PROGRESS_PREFIXES)


def dedupe_consecutive(lines: DataFrame) -> DataFrame:
    """Drop rows equal to the previous row of the execution."""
    prev = previous_line(lines)
    return prev.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("line"))).drop("_prev")


def clean_blocks(lines: DataFrame) -> DataFrame:
    """All cleaning steps; keeps the block column and its partitioning for later operators.

    Progress lines leave last: they still end a run of repeats.
    """
    text = lines.select(EXEC, LINE_NO, normalize(F.col("line")).alias("line"))
    return dedupe_consecutive(into_blocks(text.filter(F.col("line") != ""))).filter(
        ~is_progress(F.col("line"))
    )


def clean_lines(lines: DataFrame) -> DataFrame:
    return clean_blocks(lines).drop(BLOCK)


def sample_head(lines: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    """First n rows of each execution. Rows in blocks are cut to n per block in the order that the
    blocks have already; others to n per task before the shuffle."""
    by_line = Window.partitionBy(EXEC).orderBy(LINE_NO)
    if BLOCK in lines.columns:
        lines = lines.withColumn("_rn", F.row_number().over(in_block())).filter(F.col("_rn") <= n)
    return (
        lines.select(EXEC, LINE_NO, "line")
        .withColumn("_rn", F.row_number().over(by_line))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )
