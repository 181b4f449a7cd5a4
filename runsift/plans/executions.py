"""The whole analysis of executions, composed from the operators.

Log text is shuffled and sorted once, for the marked lines of the log state; what follows scans
that table with filters. What moves afterwards: rows of runs at the ends of blocks, the reduced
rows of each execution (at most 801), and rows of blocks and executions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.operators.blocks import BLOCK, EXEC
from runsift.operators.detect import as_pasted, detect_tool
from runsift.operators.digest import (
    digest_text,
    resource_usage,
    savings_percentage,
)
from runsift.operators.families import BUILT_IN, FALLBACK, RuleFamily
from runsift.operators.folds import (
    METRICS,
    event_parts,
    family_index,
    fold_blocks,
    fold_effects,
    line_effects,
    tool_events,
)
from runsift.operators.reduce import optimize_bounded
from runsift.operators.rootcause import execution_facts, with_changes
from runsift.operators.state import LogState, Stage, dropped_lines, heads_apart, log_state
from runsift.operators.suggest import RULES, Rule, rule_hits
from runsift.operators.summarize import semantic_summary, summarize_rows, with_verdict
from runsift.session import as_table
from runsift.sources.logs import split_log_blob
from runsift.sources.sinks import artifact_path

#: Bytes of tool names that may be sent to all executors; beyond, lines move once more to meet
#: the tool of their execution.
SENT_BYTES = 64 << 20
ROOT_CAUSE = "\n\nRoot cause:\n"


def analyze_logs(blobs: DataFrame) -> DataFrame:
    """Summary and counters of pasted logs (exec_id, text): clean, reduce, summarise."""
    state = log_state(split_log_blob(blobs))
    return summarize_rows(optimize_bounded(state.compressed()), blobs)


def tools_of(
    executions: DataFrame, state: LogState, families: Sequence[RuleFamily] = BUILT_IN
) -> DataFrame:
    return detect_tool(executions, state.samples(), families)


def tool_effects(tools: DataFrame, state: LogState, families: Sequence[RuleFamily]) -> DataFrame:
    """Effects of the lines of executions with a known tool, heads of blocks apart."""
    rows = heads_apart(state.marked)
    named = tools.selectExpr(EXEC, family_index(families), "argument").filter("fam >= 0")
    size = named.agg(F.sum(F.octet_length(F.col(EXEC).cast("string")) + F.octet_length("argument") + 64)).first()[0]
    if (size or 0) <= SENT_BYTES:
        return line_effects(rows.join(F.broadcast(named), EXEC), families)
    # By block, so that a long execution is no load of one task.
    blocks = state.facts.select(EXEC, F.explode(F.array(F.col(BLOCK) * 2, F.col(BLOCK) * 2 + 1)).alias(BLOCK))
    return line_effects(rows.join(blocks.join(named, EXEC), [EXEC, BLOCK]), families)


def _distinct(families: Sequence[RuleFamily]) -> list[RuleFamily]:
    return list({f.name: f for f in families}.values())


def summarize_tools(
    tools: DataFrame,
    state: LogState,
    compressed: DataFrame,
    families: Sequence[RuleFamily] = BUILT_IN,
) -> DataFrame:
    """One summary per execution of `tools` (a stored table): the fold of its family, or the
    generic summary of its compressed lines where the tool is unknown."""
    distinct = _distinct(families)
    blocks = fold_blocks(tool_effects(tools, state, distinct), distinct)
    blocks = blocks.join(dropped_lines(state), [EXEC, BLOCK], "left_anti")
    folded = fold_effects(blocks, tools, distinct)
    unknown = tools.filter(F.col("family") == FALLBACK.name).select(EXEC)
    zero = ["errors", "warnings", "_is_error", "_succeeded", "_completed", "_tested"]
    generic = with_verdict(
        unknown.join(semantic_summary(compressed), EXEC, "left").fillna(0, zero)
    ).selectExpr(
        EXEC,
        "true AS _generic",
        "status AS _status",
        "summary AS _summary",
        "errors AS _errors",
        "warnings AS _warnings",
        "CAST(coalesce(size(events), 0) AS BIGINT) AS _generic_events",
    )
    sizes = state.original_bytes().withColumnRenamed("original_bytes", "_bytes")
    replaced = {
        "status": "if(_generic, _status, status)",
        "summary": "if(_generic, _summary, summary)",
        "errors": "if(_generic, _errors, errors)",
        "warnings": "if(_generic, _warnings, warnings)",
        "event_count": "if(_generic, _generic_events, event_count)",
        "original_bytes": "coalesce(_bytes, 0L)",
    }
    return folded.join(generic, EXEC, "left").join(sizes, EXEC, "left").selectExpr(
        *[f"{replaced[c]} AS {c}" if c in replaced else c for c in folded.columns]
    )


def _events(tools: DataFrame, state: LogState, families: Sequence[RuleFamily]) -> DataFrame:
    """Kept events of known tools."""
    return tool_events(tool_effects(tools, state, families), families, dropped_lines(state))


def all_tool_events(
    executions: DataFrame,
    lines: DataFrame,
    families: Sequence[RuleFamily] = BUILT_IN,
    stage: Stage = as_table,
    block_rows: int | None = None,
) -> DataFrame:
    """Every kept event as a row (exec_id, line_no, step, event): the one place where events
    stand, however many an execution has. Executions without a known tool have up to ten, of the
    reduced log: step 0, numbered by their place."""
    state = log_state(lines, stage, block_rows)
    tools = stage(tools_of(executions, state, families))
    return _listed_events(tools, state, state.compressed(), families)


def _listed_events(tools: DataFrame, state: LogState, compressed: DataFrame, families: Sequence[RuleFamily]) -> DataFrame:
    unknown = tools.filter(F.col("family") == FALLBACK.name).select(EXEC)
    generic = unknown.join(semantic_summary(compressed), EXEC).select(
        EXEC, F.posexplode("events").alias("line_no", "event")
    )
    return _events(tools, state, _distinct(families)).unionByName(
        generic.selectExpr(EXEC, "CAST(line_no AS BIGINT) AS line_no", "0 AS step", "event")
    )


def _record_inputs(
    executions: DataFrame, lines: DataFrame, families: Sequence[RuleFamily], stage: Stage, block_rows: int | None
) -> tuple[DataFrame, LogState, DataFrame]:
    """Tools, log state and compressed lines, all stored."""
    state = log_state(lines, stage, block_rows)
    return stage(tools_of(executions, state, families)), state, stage(state.compressed())


def execution_records(
    executions: DataFrame,
    lines: DataFrame,
    changed_files: DataFrame | None = None,
    samples: DataFrame | None = None,
    families: Sequence[RuleFamily] = BUILT_IN,
    rules: tuple[Rule, ...] = RULES,
    stage: Stage = as_table,
    block_rows: int | None = None,
) -> DataFrame:
    """The records of `execution_summary` without what grows with a log: events are counted, and
    where `separator` is not null the summary text is only the head of the one that lists them. The
    events are the rows of `all_tool_events`, the texts the parts of `summary_parts`."""
    tools, state, compressed = _record_inputs(executions, lines, families, stage, block_rows)
    return _records(executions, tools, state, compressed, changed_files, samples, families, rules)


def execution_summary(
    executions: DataFrame,
    lines: DataFrame,
    changed_files: DataFrame | None = None,
    samples: DataFrame | None = None,
    families: Sequence[RuleFamily] = BUILT_IN,
    rules: tuple[Rule, ...] = RULES,
    stage: Stage = as_table,
    block_rows: int | None = None,
) -> DataFrame:
    """One structured record per execution, with all its events (`important_events`, null if it has
    none) and the whole summary text.

    executions: exec_id, command_line, cmd, exit_code, start_ts, end_ts; lines: exec_id,
    line_no, line; changed_files: exec_id, path; samples: exec_id, ts, rss_bytes, cpu_pct.
    `stage` keeps the log state, the tools and the compressed lines, each read by several steps;
    by default in tables of the shared folder, written when this is called."""
    tools, state, compressed = _record_inputs(executions, lines, families, stage, block_rows)
    records = _records(executions, tools, state, compressed, changed_files, samples, families, rules)
    return with_events(records, _listed_events(tools, state, compressed, families))


def with_events(records: DataFrame, events: DataFrame) -> DataFrame:
    """What `execution_records` gives, whole: the events (rows of `all_tool_events`) as a list, in
    order, and the texts that list them written out. `separator` is null then: no text goes on."""
    lists = events.groupBy(EXEC).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "step", "event"))).getField("event").alias("important_events")
    )
    closing = f"coalesce('{ROOT_CAUSE}' || error_intel.root_cause, '')"
    head = f"substring(summary, 1, length(summary) - length({closing}))"
    whole = f"if(separator IS NULL, summary, concat({head}, coalesce(array_join(important_events, separator), ''), {closing}))"
    replaced = {"summary": whole, "separator": "CAST(NULL AS STRING)"}
    return records.join(lists, EXEC, "left").selectExpr(
        *[f"{replaced[c]} AS {c}" if c in replaced else c for c in records.columns], "important_events"
    )


def summary_parts(
    executions: DataFrame,
    lines: DataFrame,
    changed_files: DataFrame | None = None,
    families: Sequence[RuleFamily] = BUILT_IN,
    rows_per_part: int = 1 << 12,
    stage: Stage = as_table,
    block_rows: int | None = None,
) -> DataFrame:
    """The summaries that list all events (type checks, version control) as ordered part rows: the
    head, the events, and the root cause of a failed run."""
    tools, state, compressed = _record_inputs(executions, lines, families, stage, block_rows)
    records = _records(executions, tools, state, compressed, changed_files, None, families, RULES)
    listed = stage(
        records.filter("separator IS NOT NULL").selectExpr(
            EXEC, "separator", "summary AS whole", f"'{ROOT_CAUSE}' || error_intel.root_cause AS closing"
        )
    )
    head = "if(closing IS NULL, whole, substring(whole, 1, length(whole) - length(closing)))"
    return event_parts(
        listed.selectExpr(EXEC, "separator", f"{head} AS summary", "closing"),
        _events(tools, state, _distinct(families)), rows_per_part, "closing",
    )


def _records(
    executions: DataFrame,
    tools: DataFrame,
    state: LogState,
    compressed: DataFrame,
    changed_files: DataFrame | None,
    samples: DataFrame | None,
    families: Sequence[RuleFamily],
    rules: tuple[Rule, ...],
) -> DataFrame:
    spark = executions.sparkSession
    facts = execution_facts(optimize_bounded(compressed))
    summaries = summarize_tools(tools, state, compressed, families)
    if changed_files is None:
        changed_files = executions.select(EXEC, F.lit("").alias("path")).limit(0)
    intel = with_changes(facts, changed_files)
    usage = (
        resource_usage(samples)
        if samples is not None
        else spark.createDataFrame([], executions.select(EXEC).schema).selectExpr(
            EXEC, "0D AS max_ram_mb", "0D AS avg_cpu_percent"
        )
    )
    runs = executions.selectExpr(
        EXEC,
        "cmd AS command",
        "exit_code",
        "end_ts",
        # Whole hundredths first: the digest prints two decimals, and ties would print
        # differently from one engine to the next.
        "((unix_micros(end_ts) - unix_micros(start_ts) + 5000L) div 10000L) / 100D AS wall",
    )
    joined = (
        runs.join(summaries, EXEC)
        .join(intel, EXEC, "left")
        .join(usage, EXEC, "left")
        .withColumn("failed", F.expr("exit_code <> 0 OR status = 'failure'"))
        .withColumn("explained", F.expr("failed AND root_cause IS NOT NULL"))
    )
    shown = [name for name in METRICS if name != "duration_seconds"]
    path = artifact_path("exec_id")
    record = joined.selectExpr(
        EXEC,
        "tool",
        "command",
        "if(failed, 'failure', 'success') AS status",
        f"if(explained, concat(summary, '{ROOT_CAUSE}', root_cause), summary) AS summary",
        "event_count",
        "separator",
        *shown,
        "wall AS duration_seconds",
        "coalesce(max_ram_mb, 0D) AS max_ram_mb",
        "coalesce(avg_cpu_percent, 0D) AS avg_cpu_percent",
        "original_bytes",
        "CASE WHEN explained THEN struct(root_cause, error_type, context, correlated_changes) END "
        "AS error_intel",
        f"CASE WHEN explained THEN {rule_hits(rules)} END AS suggestions",
        f"{path} AS artifact_path",
        f"if(failed, {path}, NULL) AS raw_log_path",
        "date_format(end_ts, \"yyyy-MM-dd'T'HH:mm:ssXXX\") AS timestamp",
        "key_events",
    )
    return (
        record.withColumn("compressed_context", F.expr(digest_text()))
        .withColumn("compressed_bytes", F.expr("CAST(octet_length(compressed_context) AS BIGINT)"))
        .withColumn("savings_percentage", F.expr(savings_percentage()))
        .drop("key_events")
    )


def analyze_logs_full(
    blobs: DataFrame, families: Sequence[RuleFamily] = BUILT_IN, stage: Stage = as_table
) -> DataFrame:
    """The full pipeline over pasted logs (exec_id, text): a virtual command with exit code 0
    whose command line is the log itself."""
    now = F.lit(0).cast("timestamp")
    executions = as_pasted(blobs).withColumns(
        {"cmd": F.lit("analyze"), "exit_code": F.lit(0), "start_ts": now, "end_ts": now}
    )
    return execution_records(executions, split_log_blob(blobs), families=families, stage=stage)


__all__ = [
    "all_tool_events",
    "analyze_logs",
    "analyze_logs_full",
    "execution_records",
    "execution_summary",
    "summarize_tools",
    "summary_parts",
    "tools_of",
    "with_events",
]
