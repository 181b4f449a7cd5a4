"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.functions.text import sanitize_utf8, trim
from runsift.operators import clean, detect, digest, explain, folds, history, inventory, reduce
from runsift.operators import rootcause, suggest, summarize
from runsift.operators.blocks import into_blocks
from runsift.operators.families import BUILT_IN, SHIPPED, extended_families
from runsift.operators.rules import rule_index
from runsift.operators.state import log_state
from runsift.plans import executions as plans
from runsift.plans import reports
from runsift.session import as_table
from runsift.sources import logs, sinks
from runsift.sources.history import parse_history
from workload import streams, views

Query = Callable[[SparkSession, str], DataFrame]

SEARCHES = {"tools": "npm urgent", "failed": "FAILURE", "empty": ""}
# Name of the forced tool and sub-command argument of families that need one.
FORCED = {"buildtool": "webpack", "linter": "prettier", "dbmigrate": "prisma"}
FORCED_ARGUMENT = {"git": "status"}


def joined(items: str | Column, separator: str = "\n") -> Column:
    """Lists are compared as text: engines differ in how they print arrays."""
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def bigint(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _line_query(operator: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return views.log_lines(spark, sf).select(
            "exec_id", "line_no", operator(F.col("line")).alias("line")
        )

    return run


def split_log_blob(spark, sf):
    return views.doc_lines(spark, sf)


def sanitize(spark, sf):
    """Every document with ill-formed bytes and genuine replacement characters put in; the result
    is the document with the latter."""
    kept = F.concat(F.lit("\u0001\ufffd"), F.substring("text", 1, 10), F.lit("\ufffd"))
    raw = F.concat(
        kept.cast("binary"),
        F.unhex(F.lit("FFC3")),
        F.substring(F.col("text"), 11, 1 << 30).cast("binary"),
        F.unhex(F.lit("E28C")),
    ).cast("string")
    fixed = sanitize_utf8(raw)
    return views.table(spark, sf, "documents").select(
        "doc_id", F.octet_length(fixed).cast("bigint").alias("n_bytes"), F.md5(fixed).alias("digest")
    )


def merge_streams(spark, sf):
    merged = logs.merge_streams(views.output_streams(spark, sf))
    return merged.select("exec_id", bigint("line_no"), "stream", "line")


def history_load(spark, sf):
    return parse_history(views.history_json(spark, sf))


def dedupe_consecutive(spark, sf):
    return clean.dedupe_consecutive(views.doc_lines(spark, sf)).select("exec_id", "line_no", "line")


def clean_lines(spark, sf):
    return clean.clean_lines(views.log_lines(spark, sf)).select("exec_id", "line_no", "line")


def sample_head(spark, sf):
    return clean.sample_head(clean.clean_blocks(views.log_lines(spark, sf)))


def decompose_chain(spark, sf):
    return detect.decompose_chain(views.executions(spark, sf)).select(
        "exec_id", bigint("part_no"), "part"
    )


def tokenise_command(spark, sf):
    parts = detect.decompose_chain(views.executions(spark, sf))
    return detect.tokenise_command(parts).select(
        "exec_id", bigint("part_no"), "sub_command", joined("sub_args", "|").alias("sub_args")
    )


def detect_by_command(spark, sf):
    return detect.detect_by_command(views.executions(spark, sf)).select(
        "exec_id", "tool", "family", "argument"
    )


def _samples(spark, sf):
    return clean.sample_head(clean.clean_blocks(views.log_lines(spark, sf)))


def detect_by_content(spark, sf):
    return detect.detect_by_content(_samples(spark, sf))


def detect_tool(spark, sf):
    return detect.detect_tool(views.executions(spark, sf), _samples(spark, sf))


def detect_tool_extended(spark, sf):
    return detect.detect_tool(
        views.executions(spark, sf), _samples(spark, sf), extended_families(SHIPPED)
    )


def detect_pasted(spark, sf):
    pasted = views.pasted_logs(spark, sf)
    samples = clean.sample_head(clean.clean_blocks(logs.split_log_blob(pasted)))
    return detect.detect_tool(detect.as_pasted(pasted), samples)


def summary_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "exec_id",
        "tool",
        "status",
        "summary",
        *[bigint(n) for n in ("tests_passed", "tests_failed", "warnings", "errors")],
        "duration_seconds",
        *[bigint(n) for n in ("test_files", "modules_compiled")],
        "bundle_size",
        "artifact_size",
        bigint("event_count"),
        F.coalesce("separator", F.lit("")).alias("separator"),
    )


def _fold(family) -> Query:
    def run(spark, sf):
        cleaned = clean.clean_blocks(views.log_lines(spark, sf))
        return summary_columns(
            folds.fold_as(
                cleaned, family, FORCED.get(family.name), FORCED_ARGUMENT.get(family.name, "")
            )
        )

    return run


def generic_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "exec_id", "status", "summary", "errors", "warnings", joined("events").alias("events")
    )


def fold_fallback(spark, sf):
    cleaned = clean.clean_blocks(views.log_lines(spark, sf))
    return generic_columns(summarize.summarize_rows(reduce.compress_lines(cleaned)))


def summarize_tools(spark, sf):
    state = log_state(views.log_lines(spark, sf))
    tools = as_table(plans.tools_of(views.executions(spark, sf), state))
    return summary_columns(plans.summarize_tools(tools, state, state.compressed()))


def tool_events(spark, sf):
    events = plans.all_tool_events(views.executions(spark, sf), views.log_lines(spark, sf))
    return events.select("exec_id", "line_no", bigint("step"), "event")


def summary_parts(spark, sf):
    """Parts of 64 line numbers, so that executions have many."""
    return plans.summary_parts(
        views.executions(spark, sf), views.log_lines(spark, sf), views.changed_files(spark, sf), rows_per_part=64
    )


def rle_lines(spark, sf):
    return reduce.rle_lines(views.doc_lines(spark, sf)).select("exec_id", bigint("idx"), "line")


def truncate_head_tail(spark, sf):
    return reduce.truncate_head_tail(views.long_log(spark, sf)).select(
        "exec_id", bigint("idx"), "line"
    )


def filter_dep_noise(spark, sf):
    """Over lines that get a noise prefix by their number."""
    n = F.pmod(F.col("line_no"), F.lit(4))
    lines = views.log_lines(spark, sf).withColumn(
        "line",
        F.when(n == 0, F.concat(F.lit("WARNING in Node_Modules/x: "), "line"))
        .when(n == 1, F.concat(F.lit("[INFO] Downloading "), "line"))
        .when(n == 2, F.concat(F.lit("see [info] fetching "), "line"))
        .otherwise(F.col("line")),
    )
    return reduce.filter_dep_noise(lines)


def dedupe_surviving(spark, sf):
    return reduce.dedupe_surviving(views.log_lines(spark, sf)).select("exec_id", "line_no", "line")


def group_pass_fail(spark, sf):
    return reduce.group_pass_fail(views.log_lines(spark, sf)).select(
        "exec_id", bigint("idx"), "line"
    )


def _reduced(spark, sf) -> DataFrame:
    return reduce.optimize_bounded(log_state(views.log_lines(spark, sf)).compressed())


def reduce_lines(spark, sf):
    """The reduction as its own operator, over cleaned lines."""
    return reduce.reduce_lines(clean.clean_blocks(views.log_lines(spark, sf)))


def semantic_summary(spark, sf):
    return generic_columns(summarize.summarize_rows(_reduced(spark, sf)))


def analyze_logs(spark, sf):
    return generic_columns(plans.analyze_logs(views.pasted_logs(spark, sf)))


def match_error_patterns(spark, sf):
    return rootcause.match_error_patterns(_reduced(spark, sf)).select(
        "exec_id", "idx", bigint("priority"), bigint("pattern_ix"), "error_type", "cause"
    )


def root_cause(spark, sf):
    return rootcause.root_cause(_reduced(spark, sf)).select(
        "exec_id", "idx", bigint("priority"), "error_type", "cause"
    )


def error_context(spark, sf):
    return rootcause.error_context(_reduced(spark, sf))


def correlate_changes(spark, sf):
    windows = rootcause.cause_windows(_reduced(spark, sf))
    return rootcause.correlate_changes(windows, views.changed_files(spark, sf)).select(
        "exec_id", joined("correlated_changes").alias("correlated_changes")
    )


def changed_files(spark, sf):
    return logs.changed_files(views.vcs_output(spark, sf))


def _intel(spark, sf) -> DataFrame:
    return rootcause.error_intel(_reduced(spark, sf), views.changed_files(spark, sf))


def _suggestions(df: DataFrame) -> DataFrame:
    return df.select("exec_id", joined("suggestions").alias("suggestions"))


def suggest_fixes(spark, sf):
    return _suggestions(suggest.suggest_fixes(_intel(spark, sf)))


def suggest_fixes_ext(spark, sf):
    return _suggestions(suggest.suggest_fixes(_intel(spark, sf), suggest.extended_rules()))


def _summary(spark, sf, plan=plans.execution_records, **options) -> DataFrame:
    """Records; the projections of most queries leave out the events and the texts that list them."""
    return plan(
        views.executions(spark, sf),
        views.log_lines(spark, sf),
        views.changed_files(spark, sf),
        views.resource_samples(spark, sf),
        **options,
    )


def execution_summary(spark, sf):
    return _record_columns(_summary(spark, sf, plans.execution_summary), joined("important_events").alias("important_events"))


def _record_columns(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(
        "exec_id",
        "tool",
        "command",
        "status",
        "summary",
        bigint("event_count"),
        *[bigint(n) for n in ("tests_passed", "tests_failed", "warnings", "errors")],
        *[bigint(n) for n in ("test_files", "modules_compiled")],
        "bundle_size",
        "artifact_size",
        "duration_seconds",
        "max_ram_mb",
        "avg_cpu_percent",
        F.coalesce("error_intel.root_cause", F.lit("")).alias("root_cause"),
        F.coalesce("error_intel.error_type", F.lit("")).alias("error_type"),
        joined("error_intel.context").alias("context"),
        joined("error_intel.correlated_changes").alias("correlated_changes"),
        joined("suggestions").alias("suggestions"),
        "artifact_path",
        F.coalesce("raw_log_path", F.lit("")).alias("raw_log_path"),
        "compressed_context",
        bigint("original_bytes"),
        bigint("compressed_bytes"),
        F.round("savings_percentage", 6).alias("savings_percentage"),
        *more,
    )


def analyze_logs_full(spark, sf):
    return _record_columns(plans.analyze_logs_full(views.pasted_logs(spark, sf)))


def final_status(spark, sf):
    return _summary(spark, sf).select("exec_id", "status")


def key_events(spark, sf):
    return digest.key_events(_reduced(spark, sf))


def digest_query(spark, sf):
    return _summary(spark, sf).select("exec_id", "compressed_context")


def byte_savings(spark, sf):
    return _summary(spark, sf).select(
        "exec_id",
        bigint("original_bytes"),
        bigint("compressed_bytes"),
        F.round("savings_percentage", 6).alias("savings_percentage"),
    )


def original_bytes(spark, sf):
    """Bytes before reduction, on texts with multi-byte characters."""
    return digest.original_bytes(clean.clean_lines(views.doc_lines(spark, sf))).select(
        "exec_id", bigint("original_bytes")
    )


def resource_usage(spark, sf):
    return digest.resource_usage(views.resource_samples(spark, sf))


def test_report(spark, sf):
    return reports.test_report(_summary(spark, sf)).select(
        "exec_id", "status", bigint("tests_passed"), bigint("tests_failed")
    )


def build_report(spark, sf):
    """All metrics of the report; those that vanish when zero are zero or empty again."""
    report = reports.build_report(_summary(spark, sf))
    shown = report.select("exec_id", "status", "summary", F.to_json("metrics").alias("metrics"))

    def metric(name: str) -> Column:
        value = F.get_json_object("metrics", f"$.{name}")
        if name in reports.TEXT_METRICS:
            return F.coalesce(value, F.lit("")).alias(name)
        if name in ("duration_seconds", "max_ram_mb", "avg_cpu_percent", "savings_percentage"):
            return F.round(F.coalesce(value.cast("double"), F.lit(0.0)), 6).alias(name)
        return F.coalesce(value.cast("bigint"), F.lit(0)).alias(name)

    return shown.select("exec_id", "status", "summary", *[metric(n) for n in reports.METRIC_NAMES])


def _read_back(df: DataFrame, texts: dict[str, str], lists: dict[str, str], numbers: dict[str, str]) -> list[Column]:
    """Values of a JSON column by their paths; '' and 0 where there is none."""

    def at(path: str) -> Column:
        return F.get_json_object("json", path)

    return [
        *[F.coalesce(at(path), F.lit("")).alias(name) for name, path in texts.items()],
        *[joined(F.from_json(at(path), "array<string>")).alias(name) for name, path in lists.items()],
        *[F.round(F.coalesce(at(path).cast("double"), F.lit(0.0)), 6).alias(name) for name, path in numbers.items()],
    ]


METRIC_NUMBERS = {n: f"$.metrics.{n}" for n in reports.METRIC_NAMES if n not in reports.TEXT_METRICS}


def agent_json(spark, sf):
    """The JSON for agents, read back value by value."""
    df = reports.agent_json(_summary(spark, sf))
    texts = {
        "error_type": "$.errors.error_type", "root_cause": "$.errors.root_cause", "compressed_context": "$.compressed_context",
        "artifact_size": "$.artifacts.artifact_size", "bundle_size": "$.artifacts.bundle_size", "raw_log_fallback": "$.raw_log_fallback",
    }
    lists = {"context": "$.errors.context", "correlated_changes": "$.errors.correlated_changes"}
    return df.select("exec_id", *_read_back(df, texts, lists, METRIC_NUMBERS))


RECORD_TEXTS = {
    "tool": "$.tool", "command": "$.command", "status": "$.status", "summary": "$.summary", "execution_id": "$.execution_id",
    "error_type": "$.error_intel.error_type", "root_cause": "$.error_intel.root_cause", "artifact_path": "$.artifact_path",
    "raw_log_path": "$.raw_log_path", "compressed_context": "$.compressed_context",
    "bundle_size": "$.metrics.bundle_size", "artifact_size": "$.metrics.artifact_size",
}
RECORD_LISTS = {
    "context": "$.error_intel.context", "correlated_changes": "$.error_intel.correlated_changes", "suggestions": "$.suggestions",
}


def summary_json(spark, sf):
    """The JSON record, read back value by value."""
    df = reports.summary_json(_summary(spark, sf))
    counted = {**METRIC_NUMBERS, "event_count": "$.event_count"}
    return df.select("exec_id", *_read_back(df, RECORD_TEXTS, RECORD_LISTS, counted))


def record_json(spark, sf):
    """The JSON record with all events, put together from its parts and read back."""
    records = as_table(_summary(spark, sf))
    events = as_table(plans.all_tool_events(views.executions(spark, sf), views.log_lines(spark, sf)))
    parts = reports.record_json_parts(records, events, rows_per_part=64)
    whole = parts.groupBy("exec_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("part_no", "json"))).getField("json"), "").alias("json")
    )
    lists = {**RECORD_LISTS, "important_events": "$.important_events"}
    return whole.select("exec_id", *_read_back(whole, RECORD_TEXTS, lists, METRIC_NUMBERS))


def engine_counters(spark, sf):
    return reports.engine_counters(views.executions(spark, sf))


def savings_by_tool(spark, sf):
    return reports.savings_by_tool(_summary(spark, sf))


def artifact_routing(spark, sf):
    tools = detect.detect_tool(views.executions(spark, sf), _samples(spark, sf))
    return tools.select("exec_id", sinks.artifact_name(F.col("tool")).alias("artifact_name"))


def history_list(spark, sf):
    return history.history_list(views.history(spark, sf)).select(
        bigint("entry_no"), "execution_id", "command", "status", "summary"
    )


def history_search(spark, sf):
    return history.history_search_many(views.history(spark, sf), SEARCHES).select(
        "query_id", "execution_id", "command", "status", "summary"
    )


def explain_command(spark, sf):
    commands = views.commands(spark, sf)
    e = explain.explain_single(trim(F.col("command")))
    return commands.select(trim(F.col("command")).alias("command"), e.alias("_e")).select(
        "command", "_e.type", "_e.tool", "_e.description"
    )


def explain_chain(spark, sf):
    return explain.explain_distinct(views.commands(spark, sf))


def explain_headline(spark, sf):
    return explain.headline(explain.explain_distinct(views.commands(spark, sf)))


def project_type(spark, sf):
    return inventory.project_type(views.file_listing(spark, sf))


def tool_matrix(spark, sf):
    return inventory.tool_matrix(
        views.host_tools(spark, sf), inventory.project_type(views.file_listing(spark, sf))
    )


def read_log_dir(spark, sf):
    """Write each pasted log as a file of its own and read the directory back."""
    path = streams.scratch(spark, "logs")
    sinks.write_log_dir(views.pasted_logs(spark, sf), path)
    return logs.read_log_dir(spark, path, "*.{log,txt}")


def _stored_logs(spark, sf) -> str:
    """Cleaned logs, written twice as one batch."""
    path = streams.scratch(spark, "clean")
    lines = clean.clean_lines(views.log_lines(spark, sf))
    day = views.executions(spark, sf).select("exec_id", F.to_date("start_ts").alias("day"))
    for _ in range(2):
        sinks.write_clean_logs(lines.join(day, "exec_id"), path, F.col("day"), "logs-1")
    return path


def write_clean_logs(spark, sf):
    path = _stored_logs(spark, sf)
    named = sinks.read_manifest(spark, path).select("raw_log_path")
    return sinks.read_clean_logs(spark, path, named).select("exec_id", "line_no", "line")


def log_manifest(spark, sf):
    """What the manifest says of each execution, over its files."""
    manifest = sinks.read_manifest(spark, _stored_logs(spark, sf))
    return manifest.groupBy("raw_log_path", "exec_id").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("lines").alias("lines")
    )


def raw_log(spark, sf):
    """The logs that the records of failed executions name."""
    path = _stored_logs(spark, sf)
    return sinks.read_clean_logs(spark, path, as_table(_summary(spark, sf).select("raw_log_path")))


def write_summaries(spark, sf):
    """Records written to the summary sink, twice as one batch, and read back."""
    path = streams.scratch(spark, "summaries")
    record = as_table(_record_columns(_summary(spark, sf)))
    for _ in range(2):
        sinks.write_summaries(record, path, "records-1")
    schema = "exec_id bigint, tool string, status string, summary string, errors bigint, savings_percentage double"
    return sinks.read_summaries(spark, path, schema)


def history_append(spark, sf):
    """Two batches, each appended twice."""
    from runsift.sources.history import read_history

    path = streams.scratch(spark, "history")
    past = views.history(spark, sf)
    failed = F.col("status") == "failure"
    for _ in range(2):
        sinks.append_history(past.filter(failed), path, "failed")
        sinks.append_history(past.filter(~failed), path, "others")
    return read_history(spark, path)


#: Blocks of a few lines: executions have many borders at any size of the tables.
FEW_LINES = 7


def clean_lines_blocks(spark, sf):
    """Cleaned lines from the block state."""
    return log_state(views.log_lines(spark, sf), block_rows=FEW_LINES).cleaned()


def rle_lines_blocks(spark, sf):
    lines = into_blocks(views.doc_lines(spark, sf), FEW_LINES)
    return reduce.rle_lines(lines).select("exec_id", bigint("idx"), "line")


def group_pass_fail_blocks(spark, sf):
    return reduce.group_pass_fail(views.log_lines(spark, sf), FEW_LINES).select("exec_id", bigint("idx"), "line")


def compress_lines_blocks(spark, sf):
    """Runs of documents, cut to the first and last ones, from the block state."""
    return log_state(views.doc_lines(spark, sf), block_rows=FEW_LINES).compressed()


def execution_summary_blocks(spark, sf):
    return _record_columns(_summary(spark, sf, block_rows=FEW_LINES))


def tool_events_blocks(spark, sf):
    events = plans.all_tool_events(views.executions(spark, sf), views.log_lines(spark, sf), block_rows=FEW_LINES)
    return events.select("exec_id", "line_no", bigint("step"), "event")


def suggest_fixes_by_table(spark, sf):
    """The rules as rows of a table."""
    rules = spark.createDataFrame(
        [(i, *rule) for i, rule in enumerate(suggest.RULES)], "rule_ix int, error_type string, pattern string, suggestion string"
    )
    return _suggestions(suggest.suggest_fixes_by_table(_intel(spark, sf), rule_index(rules)))


def root_cause_by_table(spark, sf):
    """The error patterns as rows of a table."""
    columns = "pattern_ix int, priority int, error_type string, pattern string, before string, after string, trimmed boolean"
    patterns = spark.createDataFrame([(i, *p) for i, p in enumerate(rootcause.ERROR_PATTERNS)], columns)
    found = rootcause.root_cause_by_table(_reduced(spark, sf), rule_index(patterns))
    return found.select("exec_id", "idx", bigint("priority"), "error_type", "cause")


# The signs of tools in a line, by precedence, as patterns.
CONTENT_PATTERNS = (
    ("vitest", r"vitest|Test Files|PASS |FAIL "),
    ("jest", r"jest|FAIL|PASS|Test Suites:"),
    ("cypress", r"cypress|Run Finished|Tests Results:"),
    ("pytest", r"test session starts|pytest|===.*passed in|passed in.*==="),
    ("go test", r"^--- PASS:|^--- FAIL:|^ok\t|^FAIL\t"),
    ("flutter_test", r"All tests passed!|Some tests failed|Shell:.*test|test.*Shell:"),
    ("vite", r"\[vite\]|(?i:vite v)"),
    ("buildtool", r"(?i:webpack|rollup|esbuild|next\.js|nuxt|compiled successfully)"),
    ("eslint", r"eslint|(?=.*error)(?=.*warning).*:"),
    ("npm", r"(?i:npm error)|npm ERR!"),
)


def detect_by_content_table(spark, sf):
    rules = spark.createDataFrame([(i, *rule) for i, rule in enumerate(CONTENT_PATTERNS)], "priority int, family string, pattern string")
    return detect.detect_by_content_table(_samples(spark, sf), rule_index(rules))


def history_index(spark, sf):
    """The searches of `history_search` over the n-gram index."""
    index = history.build_history_index(views.history(spark, sf), streams.scratch(spark, "index"))
    out = None
    for name, query in SEARCHES.items():
        part = index.search(query).select(F.lit(name).alias("query_id"), "execution_id", "command", "status", "summary")
        out = part if out is None else out.unionByName(part)
    return out


def queries() -> dict[str, Query]:
    return {
        "split_log_blob": split_log_blob,
        "read_log_dir": read_log_dir,
        "history_load": history_load,
        "sanitize_utf8": sanitize,
        "merge_streams": merge_streams,
        "write_clean_logs": write_clean_logs,
        "log_manifest": log_manifest,
        "raw_log": raw_log,
        "write_summaries": write_summaries,
        "history_append": history_append,
        "artifact_routing": artifact_routing,
        "strip_ansi": _line_query(clean.strip_ansi),
        "strip_timestamp": _line_query(clean.strip_timestamp),
        "trim_ws": _line_query(trim),
        "dedupe_consecutive": dedupe_consecutive,
        "clean_lines": clean_lines,
        "sample_head": sample_head,
        "decompose_chain": decompose_chain,
        "tokenise_command": tokenise_command,
        "detect_by_command": detect_by_command,
        "detect_by_content": detect_by_content,
        "detect_tool": detect_tool,
        "detect_tool_extended": detect_tool_extended,
        "detect_pasted": detect_pasted,
        **{f"fold_{f.name.replace(' ', '_').replace('-', '_')}": _fold(f) for f in BUILT_IN},
        "fold_fallback": fold_fallback,
        "summarize_tools": summarize_tools,
        "tool_events": tool_events,
        "summary_parts": summary_parts,
        "rle_lines": rle_lines,
        "truncate_head_tail": truncate_head_tail,
        "filter_dep_noise": filter_dep_noise,
        "dedupe_surviving": dedupe_surviving,
        "group_pass_fail": group_pass_fail,
        "reduce_lines": reduce_lines,
        "semantic_summary": semantic_summary,
        "analyze_logs": analyze_logs,
        "analyze_logs_full": analyze_logs_full,
        "match_error_patterns": match_error_patterns,
        "root_cause": root_cause,
        "error_context": error_context,
        "correlate_changes": correlate_changes,
        "changed_files": changed_files,
        "suggest_fixes": suggest_fixes,
        "suggest_fixes_ext": suggest_fixes_ext,
        "final_status": final_status,
        "key_events": key_events,
        "digest": digest_query,
        "byte_savings": byte_savings,
        "original_bytes": original_bytes,
        "resource_usage": resource_usage,
        "execution_summary": execution_summary,
        "test_report": test_report,
        "build_report": build_report,
        "agent_json": agent_json,
        "summary_json": summary_json,
        "record_json": record_json,
        "engine_counters": engine_counters,
        "savings_by_tool": savings_by_tool,
        "history_list": history_list,
        "history_search": history_search,
        "explain_command": explain_command,
        "explain_chain": explain_chain,
        "explain_headline": explain_headline,
        "project_type": project_type,
        "tool_matrix": tool_matrix,
        "clean_lines_blocks": clean_lines_blocks,
        "rle_lines_blocks": rle_lines_blocks,
        "group_pass_fail_blocks": group_pass_fail_blocks,
        "compress_lines_blocks": compress_lines_blocks,
        "execution_summary_blocks": execution_summary_blocks,
        "tool_events_blocks": tool_events_blocks,
        "suggest_fixes_by_table": suggest_fixes_by_table,
        "root_cause_by_table": root_cause_by_table,
        "detect_by_content_table": detect_by_content_table,
        "history_index": history_index,
        "stream_clean": streams.stream_clean,
        "stream_summaries": streams.stream_summaries,
        "stream_heartbeat": streams.stream_heartbeat,
        "stream_counters": streams.stream_counters,
        "stream_history": streams.stream_history,
    }
