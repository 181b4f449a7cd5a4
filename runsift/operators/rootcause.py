"""Root cause of failed executions, its context, and recently changed files near it.

All inputs are reduced lines, so an execution has a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.functions.sqltext import extract, has, lit, match, trim
from runsift.operators.blocks import EXEC
from runsift.operators.digest import KEY_EVENTS, is_key_event
from runsift.operators.reduce import IDX
from runsift.operators.rules import matching
from runsift.session import as_table

# Fixed values, in order of precedence: priority, error type, pattern, text before the capture,
# text after it, whether the capture is trimmed.
ERROR_PATTERNS = (
    (1, "module_resolution", r"Module not found: Can't resolve '(.*?)'", "Module not found '", "'", False),
    (1, "file_not_found", r"Cannot find file '(.*?)'", "Cannot find file '", "'", False),
    (1, "build_failure", r"(?i)build failed:?\s*(.*)", "Build failed: ", "", True),
    (2, "exception", r"(?i)Exception:\s*(.*)", "Exception: ", "", False),
    (2, "panic", r"(?i)panic:\s*(.*)", "Panic: ", "", False),
    (2, "fatal_error", r"(?i)fatal error:\s*(.*)", "Fatal error: ", "", False),
    (3, "lint_error", r"\d+:\d+\s+error\s+(.*)", "", "", False),
    (3, "generic_error", r"(?i)^Error:\s*(.*)", "", "", False),
    (3, "generic_error", r"^ERROR\s+(.*)", "", "", False),
    (4, "warning", r"(?i)^Warning:\s*(.*)", "", "", True),
)
# No pattern can match a line without one of these words.
SIGNS = ("module not found", "cannot find file", "build failed", "exception", "panic", "error", "warning")
CONTEXT_BEFORE, CONTEXT_AFTER = 1, 1
NEAR_BEFORE, NEAR_AFTER = 5, 4
# Characters by which changed files find the lines that may name them.
KEY, SHORT_KEY = 8, 3


def pattern_hit(index: str = "idx") -> str:
    """SQL of the first matching pattern of `line`, by precedence, as struct(priority, at,
    pattern_ix, error_type, cause). Its order is that of the best cause of an execution:
    priority, then earliest line.

    The patterns are listed by priority, so within a line the first is also the best.
    """
    cases = []
    for ix, (priority, kind, pattern, before, after, trimmed) in enumerate(ERROR_PATTERNS):
        captured = extract("_text", pattern)
        cause = trim(captured) if trimmed else captured
        cases.append(
            f"WHEN {match('_text', pattern)} THEN struct({priority} AS priority, {index} AS at, "
            f"{ix} AS pattern_ix, {lit(kind)} AS error_type, "
            f"concat({lit(before)}, {cause}, {lit(after)}) AS cause)"
        )
    return f"CASE WHEN {has('lower(_text)', *SIGNS)} THEN CASE {' '.join(cases)} END END"


def _with_hit(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(EXEC, IDX, "line", f"{trim('line')} AS _text").selectExpr(
        EXEC, IDX, "line", f"{pattern_hit(IDX)} AS _hit"
    )


def match_error_patterns(rows: DataFrame) -> DataFrame:
    return (
        _with_hit(rows)
        .filter("_hit IS NOT NULL")
        .select(EXEC, IDX, "_hit.priority", "_hit.pattern_ix", "_hit.error_type", "_hit.cause")
    )


def root_cause(rows: DataFrame) -> DataFrame:
    """Best cause per execution: priority, then earliest line, then pattern order."""
    return (
        _with_hit(rows)
        .groupBy(EXEC)
        .agg(F.min("_hit").alias("_best"))
        .filter("_best IS NOT NULL")
        .selectExpr(
            EXEC, f"_best.at AS {IDX}", "_best.priority", "_best.error_type", "_best.cause AS cause"
        )
    )


def root_cause_by_table(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """`root_cause` for patterns kept in a table of any size (`rule_index` of priority, pattern_ix,
    error_type, pattern, before, after, trimmed): the best of an execution is that of the lowest
    priority, then the earliest line, then the first pattern."""
    text = rows.selectExpr(EXEC, IDX, f"{trim('line')} AS _text")
    captured = "regexp_extract(_text, java_pattern, 1)"
    hits = matching(text, "_text", patterns.withColumn("_again", F.col("java_pattern")))
    cause = f"concat(before, if(trimmed, {trim(captured)}, {captured}), after)".replace("java_pattern", "_again")
    return (
        hits.selectExpr(EXEC, f"struct(priority, {IDX} AS at, pattern_ix, error_type, {cause} AS cause) AS _hit")
        .groupBy(EXEC)
        .agg(F.min("_hit").alias("_best"))
        .selectExpr(
            EXEC, f"_best.at AS {IDX}", "_best.priority", "_best.error_type", "_best.cause AS cause"
        )
    )


def _around(before: int, after: int) -> str:
    first = f"greatest(_best.at - {before}, 0)"
    return (
        f"slice(_lines.line, CAST({first} AS INT) + 1, "
        f"CAST(_best.at + {after} - {first} AS INT) + 1)"
    )


def execution_facts(rows: DataFrame) -> DataFrame:
    """One row per execution: its cause (null if none) with the lines around it, and its key
    events. One aggregate: reduced rows are few per execution, so their list is bounded and
    neighbours are slices of it."""
    return (
        _with_hit(rows)
        .groupBy(EXEC)
        .agg(
            F.min("_hit").alias("_best"),
            F.expr(f"sort_array(collect_list(struct({IDX}, line))) AS _lines"),
            F.expr(
                f"sort_array(collect_list(CASE WHEN {is_key_event()} THEN struct({IDX}, line) END)) "
                "AS _keys"
            ),
        )
        .selectExpr(
            EXEC,
            "_best.at AS at",
            "_best.error_type AS error_type",
            "_best.cause AS cause",
            f"CASE WHEN _best IS NOT NULL THEN {_around(CONTEXT_BEFORE, CONTEXT_AFTER)} END AS context",
            f"CASE WHEN _best IS NOT NULL THEN {_around(NEAR_BEFORE, NEAR_AFTER)} END AS _near",
            f"slice(_keys.line, greatest(size(_keys) - {KEY_EVENTS - 1}, 1), {KEY_EVENTS}) AS key_events",
        )
    )


def cause_windows(rows: DataFrame) -> DataFrame:
    """Executions that have a cause: the cause, its context lines and the lines near it."""
    return execution_facts(rows).filter("cause IS NOT NULL").drop("key_events")


def error_context(rows: DataFrame) -> DataFrame:
    """The reduced lines around the cause, as rows."""
    return (
        cause_windows(rows)
        .select(EXEC, "at", F.posexplode("context").alias("_k", "line"))
        .selectExpr(EXEC, f"greatest(at - {CONTEXT_BEFORE}, 0) + _k AS {IDX}", "line")
    )


def _keys(text: str, length: int) -> str:
    """SQL of all distinct pieces of `length` characters of a text."""
    places = f"sequence(1, length({text}) - {length} + 1)"
    pieces = f"transform({places}, i -> substring({text}, i, {length}))"
    return f"CASE WHEN length({text}) >= {length} THEN {pieces} ELSE CAST(array() AS array<string>) END"


def correlate_changes(windows: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Sorted distinct changed files named by a line near the cause.

    A line that names a path holds the path's last part, and so the first characters of that part:
    paths and lines meet by equality on them, spread by execution and characters, and only then is
    the whole path looked for. Paths too short for that are compared with the few lines of their
    execution.

    An execution has a row for each piece of its lines, so these rows hold the piece alone; the
    lines come back to what was found. Both joins are shuffled: from the compressed files below,
    Spark would take the pieces for small and send them all to the driver."""
    last = "substring_index(path, '/', -1)"
    text = f"if(length({last}) >= {SHORT_KEY}, {last}, path)"
    key = f"substring({text}, 1, CASE WHEN length({text}) >= {KEY} THEN {KEY} WHEN length({text}) >= {SHORT_KEY} THEN {SHORT_KEY} ELSE 0 END)"
    files = changed_files.select(EXEC, "path").distinct().withColumn("_key", F.expr(key))
    near = windows.filter("cause IS NOT NULL").select(EXEC, "_near")
    pieces = near.selectExpr(
        EXEC,
        "explode(array_distinct(concat(array(''), flatten(transform(_near, x -> concat("
        f"{_keys('x', KEY)}, {_keys('x', SHORT_KEY)})))))) AS _key",
    )
    found = files.hint("merge").join(pieces, [EXEC, "_key"]).select(EXEC, "path")
    return (
        found.hint("merge")
        .join(near, EXEC)
        .filter("exists(_near, x -> contains(x, path))")
        .groupBy(EXEC)
        .agg(F.sort_array(F.collect_list("path")).alias("correlated_changes"))
    )


def with_changes(windows: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Add root_cause (the cause with the note on changed files) and correlated_changes."""
    changes = correlate_changes(windows, changed_files)
    note = (
        "concat('\\n\\nNote: This error might be related to recent changes in: ', "
        "array_join(correlated_changes, ', '))"
    )
    return (
        windows.join(changes, EXEC, "left")
        .withColumn("root_cause", F.expr(f"concat(cause, coalesce({note}, ''))"))
        .withColumn(
            "correlated_changes",
            F.expr("coalesce(correlated_changes, CAST(array() AS array<string>))"),
        )
        .drop("cause", "at", "_near")
    )


def error_intel(rows: DataFrame, changed_files: DataFrame) -> DataFrame:
    """exec_id, error_type, context, root_cause, correlated_changes.

    The search for changed files reads the windows twice and their causes once, so that they are
    stored: a row of a few lines for each execution that has a cause."""
    return with_changes(as_table(cause_windows(rows), "windows"), changed_files)
