"""Fix suggestions from an ordered rule table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.functions.sqltext import lit, match, when
from runsift.operators.blocks import EXEC
from runsift.operators.families import SHIPPED, Extension
from runsift.operators.rules import matching

# Fixed values, in order: error type ("" = any), pattern, suggestion.
RULES = (
    ("module_resolution", r"(?i)module not found|can't resolve", "Check import path or ensure the component exists."),
    ("file_not_found", r"(?i)cannot find file", "Verify the file path and ensure it has not been renamed or deleted."),
    ("lint_error", r"(?i)missing semicolon", "Add a semicolon at the indicated line."),
    ("build_failure", r"(?i)gradle task failed", "Run: flutter clean && flutter pub get"),
    ("", r"(?i)tests failed|test suite failed", "Inspect failing test cases and verify expected outputs."),
    ("generic_error", r"(?i)address already in use|EADDRINUSE", "Port conflict detected. Try running: 'npx kill-port <port>' or use a different port."),
    ("", r"(?i)out of memory|heap limit", "Process ran out of memory. Try increasing Node.js memory limit with: 'NODE_OPTIONS=--max-old-space-size=4096'"),
    ("", r"(?i)permission denied|EACCES", "Permission error. Check file ownership or try running with elevated privileges."),
    ("", r"(?i)ENOSPC|no space left on device", "Disk is full. Free up some space or check your temporary directory."),
    ("warning", r"(?i)unused variable", "Remove the unused variable or prefix it with an underscore if intentional."),
)

Rule = tuple[str, str, str]


def extended_rules(
    extensions: Iterable[Extension] = SHIPPED, rules: tuple[Rule, ...] = RULES
) -> tuple[Rule, ...]:
    """Each registered rule goes to the front, so the last extension comes first."""
    for extension in extensions:
        for rule in extension.suggestion_rules:
            rules = (rule, *rules)
    return rules


def rule_hits(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL of an array with the suggestion of each rule that applies to root_cause and error_type, in rule
    order (repeats dropped).

    The rules are few and known when the plan is built: compiled into constant patterns they
    cost one row-local expression, and no join.
    """
    hits = []
    for kind, pattern, text in rules:
        applies = match("lower(root_cause)", pattern)
        if kind:
            applies = f"lower(error_type) = {lit(kind)} AND {applies}"
        hits.append(when(applies, lit(text)))
    return f"array_distinct(filter(array({', '.join(hits)}), x -> x IS NOT NULL))"


def suggest_fixes(intel: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """exec_id and its ordered suggestions; executions without any are left out."""
    return (
        intel.filter(F.col("root_cause") != "")
        .selectExpr(EXEC, f"{rule_hits(rules)} AS suggestions")
        .filter(F.size("suggestions") > 0)
    )


def suggest_fixes_by_table(intel: DataFrame, rules: DataFrame) -> DataFrame:
    """What `suggest_fixes` gives, for rules (rule_ix, error_type, pattern, suggestion) kept in a
    table of any size, as `rule_index` prepares them. The best place of each suggestion is kept."""
    typed = intel.filter(F.col("root_cause") != "").select(
        EXEC, F.lower("root_cause").alias("_cause"), F.lower("error_type").alias("_type")
    )
    return (
        matching(typed, "_cause", rules)
        .filter("error_type = '' OR error_type = _type")
        .groupBy(EXEC, "suggestion")
        .agg(F.min("rule_ix").alias("rule_ix"))
        .groupBy(EXEC)
        .agg(
            F.sort_array(F.collect_list(F.struct("rule_ix", "suggestion")))
            .getField("suggestion")
            .alias("suggestions")
        )
    )
