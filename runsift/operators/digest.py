"""Key events, digest text, byte savings, resource usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.functions.sqltext import has, lit, when
from runsift.operators.blocks import by_exec, EXEC
from runsift.operators.reduce import IDX

# Fixed values.
KEY_EVENTS = 15
NOISE_WORDS = ("progress", "downloading", "fetching")
KEY_WORDS = ("error", "fail", "success", "build", "test", "built", "artifact")
BYTES_PER_MB = 1024 * 1024


def is_key_event() -> str:
    low = "lower(line)"
    return f"({has(low, *KEY_WORDS)} AND NOT {has(low, *NOISE_WORDS)})"


def key_events(rows: DataFrame, n: int = KEY_EVENTS) -> DataFrame:
    """The last n informative rows of each execution."""
    latest = by_exec().orderBy(F.col(IDX).desc())
    return (
        rows.filter(is_key_event())
        .withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") <= n)
        .select(EXEC, IDX, "line")
    )


# Label, column, unit and condition of each fact in the digest.
FACTS = (
    ("Modules compiled: ", "modules_compiled", "", "modules_compiled > 0"),
    ("Tests passed: ", "tests_passed", "", "tests_passed > 0"),
    ("Tests failed: ", "tests_failed", "", "tests_failed > 0"),
    ("Bundle size: ", "bundle_size", "", "bundle_size <> ''"),
    ("Artifact size: ", "artifact_size", "", "artifact_size <> ''"),
    ("Duration: ", "format_string('%.2f', duration_seconds)", "s", "duration_seconds > 0"),
)


def digest_text() -> str:
    """SQL of the digest block over a summary row with its key_events. Absent facts are null,
    and `concat_ws` skips them."""
    facts = [when(shown, lit(label), value, lit(unit)) for label, value, unit, shown in FACTS]
    listed = when(
        "size(key_events) > 0 AND status <> 'success'",
        lit("\nKey Events:\n- "),
        "array_join(key_events, '\\n- ')",
    )
    head = "concat('Command: ', command), concat('Status: ', status)"
    return f"concat_ws('\\n', {head}, {', '.join(facts)}, {listed})"


def savings_percentage() -> str:
    return (
        "CASE WHEN original_bytes > 0 THEN greatest(CAST(original_bytes - compressed_bytes AS DOUBLE)"
        " / original_bytes * 100D, 0D) ELSE 0D END"
    )


def original_bytes(cleaned: DataFrame) -> DataFrame:
    """UTF-8 bytes of the cleaned log, one newline per line."""
    return cleaned.groupBy(EXEC).agg(F.sum(F.octet_length("line") + 1).alias("original_bytes"))


def resource_usage(samples: DataFrame) -> DataFrame:
    """Peak memory in MB and mean of the positive CPU samples (0 when there is none)."""
    return samples.groupBy(EXEC).agg(
        (F.coalesce(F.max("rss_bytes"), F.lit(0)) / F.lit(BYTES_PER_MB)).alias("max_ram_mb"),
        F.coalesce(F.avg(F.when(F.col("cpu_pct") > 0, F.col("cpu_pct"))), F.lit(0.0)).alias(
            "avg_cpu_percent"
        ),
    )
