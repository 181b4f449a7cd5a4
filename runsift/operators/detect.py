"""Tool detection: rules over the command line, then over the first lines of the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.sqltext import lit, trim
from runsift.functions.text import FIELD_SEPARATOR, re2
from runsift.operators.blocks import EXEC, LINE_NO
from runsift.operators.families import BUILT_IN, FALLBACK, RuleFamily
from runsift.operators.rules import matching

# Fixed value: shell separators between the parts of a command line.
CHAIN_PATTERN = r"&&|;|\|\||\|"

#: Blanks around separators go when the parts are trimmed: looking for them at every blank of a long
#: text takes longer than all else.
PARTS = (
    f"filter(transform(split(command_line, {lit(re2(CHAIN_PATTERN))}, -1), p -> {trim('p')}), "
    "p -> p <> '')"
)


def _tokens(part: str, most: int = -1) -> str:
    """The words of a part; with `most`, that many of a trimmed one and then the rest."""
    limit = most + 1 if most > 0 else -1
    return f"filter(split({part}, {lit(FIELD_SEPARATOR)}, {limit}), t -> t <> '')"


def decompose_chain(executions: DataFrame) -> DataFrame:
    """Trimmed non-blank parts of each command chain, in order."""
    return executions.select(EXEC, F.posexplode(F.expr(PARTS)).alias("part_no", "part"))


def tokenise_command(parts: DataFrame) -> DataFrame:
    return parts.withColumn("_w", F.expr(_tokens("part"))).selectExpr(
        EXEC,
        "part_no",
        "get(_w, 0) AS sub_command",
        "slice(_w, 2, greatest(size(_w) - 1, 0)) AS sub_args",
    )


def command_hit(families: Sequence[RuleFamily] = BUILT_IN) -> Column:
    """The hit of the last part of `command_line` that any family claims; null if none does.

    Row-local: no explode and no shuffle, however many parts a line has.
    """
    words = f"transform({PARTS}, p -> {_tokens('p', 3)})"
    heads = (
        f"transform({words}, w -> struct(get(w, 0) AS c, coalesce(get(w, 1), '') AS a1, "
        "coalesce(get(w, 2), '') AS a2))"
    )
    rules = " ".join(
        f"WHEN {f.by_command('x.c', 'x.a1', 'x.a2')} THEN struct({f.command_tool('x.c')} AS tool, "
        f"{lit(f.name)} AS family, x.a1 AS argument)"
        for f in families
        if f.by_command is not None
    )
    hits = f"filter(transform({heads}, x -> CASE {rules} END), h -> h IS NOT NULL)"
    return F.expr(f"try_element_at({hits}, -1)")


def detect_by_command(
    executions: DataFrame, families: Sequence[RuleFamily] = BUILT_IN
) -> DataFrame:
    hit = command_hit(families).alias("_hit")
    return executions.select(EXEC, hit).select(EXEC, "_hit.tool", "_hit.family", "_hit.argument")


def detect_by_content(samples: DataFrame, families: Sequence[RuleFamily] = BUILT_IN) -> DataFrame:
    """The family of lowest priority index that matches any sample; a keyword family is named
    after its first matching line. `samples` holds at most ten lines per execution.

    Within one line only the first matching family can be the minimum of the execution.
    """
    rules = " ".join(
        f"WHEN {f.by_content} THEN struct({k} AS priority, {LINE_NO} AS line_no, "
        f"{f.content_tool()} AS tool, {lit(f.name)} AS family)"
        for k, f in enumerate(families)
        if f.by_content is not None
    )
    return (
        samples.withColumn("low", F.lower("line"))
        .selectExpr(EXEC, f"CASE {rules} END AS _hit")
        .filter("_hit IS NOT NULL")
        .groupBy(EXEC)
        .agg(F.min("_hit").alias("_hit"))
        .select(EXEC, "_hit.tool", "_hit.family")
    )


def detect_by_content_table(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """exec_id and family by rules (priority, family, pattern) kept in a table of any size, as
    `rule_index` prepares them: the lowest priority that matches any sample."""
    return (
        matching(samples.select(EXEC, LINE_NO, "line"), "line", rules)
        .groupBy(EXEC)
        .agg(F.min(F.struct("priority", LINE_NO, "family")).alias("_hit"))
        .select(EXEC, "_hit.family")
    )


def detect_tool(
    executions: DataFrame, samples: DataFrame, families: Sequence[RuleFamily] = BUILT_IN
) -> DataFrame:
    """One row per execution: tool, family and the first argument of the matched sub-command."""
    by_content = detect_by_content(samples, families).withColumnsRenamed(
        {"tool": "_tool", "family": "_family"}
    )
    last = lit(FALLBACK.name)
    return (
        detect_by_command(executions, families)
        .join(by_content, EXEC, "left")
        .selectExpr(
            EXEC,
            f"coalesce(tool, _tool, {last}) AS tool",
            f"coalesce(family, _family, {last}) AS family",
            "coalesce(argument, '') AS argument",
        )
    )


def as_pasted(pasted: DataFrame) -> DataFrame:
    """The virtual command of pasted logs: the log text itself stands in the command line."""
    return pasted.select(EXEC, F.concat(F.lit("analyze --raw "), "text").alias("command_line"))
