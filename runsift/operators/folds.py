"""The tool-log fold: one grouped job for all families.

Per line, each effect of the execution's family becomes a column (a CASE over the families when
several are in play). The columns are aggregated per (exec_id, block), where the lines already
are, and the block rows are combined per execution; a long execution therefore reaches the
second step as one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.operators.blocks import BLOCK, EXEC, LINE_NO, by_exec, into_blocks
from runsift.operators.families import BUILT_IN, RuleFamily

ADDS = ("errors", "warnings", "passed", "failed")
SETS = {
    "errors": "bigint",
    "warnings": "bigint",
    "passed": "bigint",
    "failed": "bigint",
    "files": "bigint",
    "modules": "bigint",
    "duration": "double",
    "bundle": "string",
    "artifact": "string",
}
ZERO = {"bigint": "0L", "double": "0D", "string": "''"}
EFFECTS = {
    "fails": "boolean",
    "mark": "boolean",
    **{f"add_{n}": "boolean" for n in ADDS},
    **{f"set_{n}": kind for n, kind in SETS.items()},
    "event": "string",
    "event2": "string",
}
METRICS = {
    "tests_passed": "passed",
    "tests_failed": "failed",
    "warnings": "warnings",
    "errors": "errors",
    "duration_seconds": "duration",
    "test_files": "files",
    "modules_compiled": "modules",
    "bundle_size": "bundle",
    "artifact_size": "artifact",
}


def _by_family(choices: dict[int, str], kind: str, total: int) -> str:
    """The choice of the row's family: one CASE branch per distinct choice, and no CASE at all
    when there is one family only."""
    if not choices:
        return f"CAST(NULL AS {kind})"
    if total == 1:
        return f"CAST(({choices[0]}) AS {kind})"
    alike: dict[str, list[str]] = {}
    for ix, sql in choices.items():
        alike.setdefault(sql, []).append(str(ix))
    cases = " ".join(f"WHEN fam IN ({', '.join(ixs)}) THEN ({sql})" for sql, ixs in alike.items())
    return f"CAST(CASE {cases} END AS {kind})"


def family_index(families: Sequence[RuleFamily]) -> str:
    cases = " ".join(f"WHEN '{f.name}' THEN {ix}" for ix, f in enumerate(families))
    return f"CASE family {cases} ELSE -1 END AS fam"


def line_effects(rows: DataFrame, families: Sequence[RuleFamily]) -> DataFrame:
    """Effect columns of every line. `rows` carries line, fam (index of the family) and
    argument.

    The flags of a family come first, as columns of their own: effects share them, and much of
    what the families do with a flag is alike.
    """
    total = len(families)
    flags, columns = [], []
    for n in range(max(len(f.flags) for f in families)):
        choices = {ix: f.flags[n] for ix, f in enumerate(families) if n < len(f.flags)}
        flags.append(f"{_by_family(choices, 'boolean', total)} AS _f{n}")

    def over_flags(family: RuleFamily, sql: str) -> str:
        for n, flag in enumerate(family.flags):
            sql = sql.replace(flag, f"_f{n}")
        return sql

    for name, kind in EFFECTS.items():
        choices = {
            ix: over_flags(f, f.effects[name]) for ix, f in enumerate(families) if name in f.effects
        }
        columns.append(f"{_by_family(choices, kind, total)} AS {name}")
    for name, attribute in (("cap", "event_cap"), ("cap2", "event2_cap")):
        caps = {ix: getattr(f, attribute) for ix, f in enumerate(families)}
        known = {ix: str(c) for ix, c in caps.items() if c is not None}
        columns.append(f"{_by_family(known, 'int', total)} AS {name}")
    return (
        rows.withColumn("low", F.lower("line"))
        .selectExpr(EXEC, BLOCK, LINE_NO, "line", "low", "fam", "argument", *flags)
        .selectExpr(EXEC, BLOCK, LINE_NO, "octet_length(line) + 1 AS bytes", "fam", *columns)
    )


def _last(value: str, order: str) -> str:
    return f"max_by({value}, CASE WHEN {value} IS NOT NULL THEN {order} END) AS {value}"


def _first_events(families: Sequence[RuleFamily]) -> int:
    """Event lines that the caps of the families can reach; 0 if none has a cap."""
    caps = [c for f in families for c in (f.event_cap, f.event2_cap) if c is not None]
    return max(caps, default=0)


def _resets(families: Sequence[RuleFamily]) -> str:
    """SQL: whether the row's family has totals lines, which reset its counters; '' if none has."""
    with_totals = [str(ix) for ix, f in enumerate(families) if "set_errors" in f.effects]
    return f"fam IN ({', '.join(with_totals)})" if with_totals else ""


def fold_blocks(effects: DataFrame, families: Sequence[RuleFamily]) -> DataFrame:
    """Block rows of the fold; needs no order of the lines. A totals line resets the error and
    warning counters, so counts are taken after the last reset of the block, and the block
    remembers that it had one. Families with totals lines keep the numbers of what they count, at
    most a block of them, until the last reset of the block is known.

    Events are only counted. Where families cap them, a block also keeps its first event lines,
    as many as the largest cap, to tell how many of the capped ones stay."""
    listed = f"struct({LINE_NO}, event IS NOT NULL AS one, cap, event2 IS NOT NULL AS two, cap2)"
    has_event = "(event IS NOT NULL OR event2 IS NOT NULL)"
    first, resets = _first_events(families), _resets(families)
    aggregates = [
        *[f"count_if(add_{n}) AS add_{n}" for n in ADDS],
        *[_last(f"set_{n}", LINE_NO) for n in SETS],
        _last("fails", LINE_NO),
        "max(mark) AS mark",
        "sum(bytes) AS bytes",
        "count_if(event IS NOT NULL AND cap IS NULL) + "
        "count_if(event2 IS NOT NULL AND cap2 IS NULL) AS _open_events",
    ]
    if resets:
        aggregates.append(f"max(CASE WHEN set_errors IS NOT NULL THEN {LINE_NO} END) AS _reset")
        aggregates += [f"collect_list(CASE WHEN {resets} AND add_{n} THEN {LINE_NO} END) AS _at_{n}" for n in ADDS]
    if first:
        capped = f"{has_event} AND (cap IS NOT NULL OR cap2 IS NOT NULL)"
        aggregates.append(
            f"slice(sort_array(collect_list(CASE WHEN {capped} THEN {listed} END)), 1, {first}) AS _list"
        )
    grouped = effects.groupBy(EXEC, BLOCK).agg(*[F.expr(a) for a in aggregates])
    if not resets:
        return grouped.withColumn("_had_reset", F.lit(False))
    after = {
        f"add_{n}": F.expr(f"if(_reset IS NULL, add_{n}, CAST(size(filter(_at_{n}, x -> x > _reset)) AS BIGINT))") for n in ADDS
    }
    return (
        grouped.withColumns(after)
        .withColumn("_had_reset", F.col("_reset").isNotNull())
        .drop("_reset", *[f"_at_{n}" for n in ADDS])
    )


def combine_blocks(blocks: DataFrame, families: Sequence[RuleFamily]) -> DataFrame:
    """One row per execution from its block rows."""
    live = f"(_last_reset IS NULL OR {BLOCK} >= _last_reset)"
    first = _first_events(families)
    aggregates = [
        *[f"sum(CASE WHEN {live} THEN add_{n} ELSE 0 END) AS add_{n}" for n in ADDS],
        *[_last(f"set_{n}", BLOCK) for n in SETS],
        _last("fails", BLOCK),
        "max(mark) AS mark",
        "sum(bytes) AS bytes",
        "sum(_open_events) AS _open_events",
    ]
    if first:
        # Blocks among the first `first` that have capped events hold all that the caps leave.
        lists = f"CASE WHEN _rank <= {first} AND size(_list) > 0 THEN struct({BLOCK}, _list) END"
        aggregates.append(f"slice(flatten(sort_array(collect_list({lists}))._list), 1, {first}) AS _list")
        blocks = blocks.withColumn(
            "_rank",
            F.expr(
                f"sum(CAST(size(_list) > 0 AS INT)) OVER (PARTITION BY {EXEC} ORDER BY {BLOCK} "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            ),
        )
    return (
        blocks.withColumn("_last_reset", F.max(F.expr(f"CASE WHEN _had_reset THEN {BLOCK} END")).over(by_exec()))
        .groupBy(EXEC)
        .agg(*[F.expr(a) for a in aggregates])
    )


def event_rows(effects: DataFrame) -> DataFrame:
    """Candidate events (exec_id, block, line_no, step, event, cap), before the caps."""
    # The filter stays behind the generator: before it, each event's rules would be evaluated once
    # more for the test, in code too long to compile.
    return effects.selectExpr(
        EXEC,
        BLOCK,
        LINE_NO,
        "inline(array(struct(1 AS step, event AS event, cap AS cap), "
        "struct(2 AS step, event2 AS event, cap2 AS cap)))",
    ).filter("event IS NOT NULL")


def tool_events(effects: DataFrame, families: Sequence[RuleFamily] = BUILT_IN, dropped: DataFrame | None = None) -> DataFrame:
    """All kept events as rows in (line_no, step) order, however many an execution has; those of
    blocks in `dropped` (exec_id, block) do not count.

    Uncapped events need no ranking. Capped ones only can be among the first `cap` candidates,
    and Spark cuts to that many rows per task before the shuffle.
    """
    candidates = event_rows(effects)
    if dropped is not None:
        candidates = candidates.join(dropped, [EXEC, BLOCK], "left_anti")
    candidates = candidates.drop(BLOCK)
    caps = [c for f in families for c in (f.event_cap, f.event2_cap) if c is not None]
    kept = candidates.filter("cap IS NULL")
    if caps:
        order = by_exec().orderBy(LINE_NO, "step")
        capped = (
            candidates.withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") <= max(caps))
            .filter("_rn <= cap")
        )
        kept = kept.unionByName(capped.drop("_rn"))
    return kept.drop("cap")


def verdicts(folded: DataFrame, families: Sequence[RuleFamily]) -> DataFrame:
    """Status and text from the metrics. `folded` has one row per execution with tool, fam,
    argument and (maybe null) fold columns.

    `event_count` counts the kept events; they stand in the rows of `tool_events`. `separator` is
    not null where the reference's text goes on with all events, one separator between."""
    metrics = [
        f"coalesce(set_{n}, {ZERO[kind]})" + (f" + coalesce(add_{n}, 0L)" if n in ADDS else "") + f" AS {n}"
        for n, kind in SETS.items()
    ]
    capped = "0L"
    if _first_events(families):
        each = (
            "filter(flatten(transform(_list, x -> array(struct(x.one AS has, x.cap AS cap), "
            "struct(x.two AS has, x.cap2 AS cap)))), x -> x.has)"
        )
        capped = f"CAST(coalesce(size(filter({each}, (x, i) -> i < x.cap)), 0) AS BIGINT)"
    base = folded.selectExpr(
        EXEC,
        "tool",
        "fam",
        "argument",
        "coalesce(fails, false) AS failing",
        "coalesce(mark, false) AS mark",
        *metrics,
        "coalesce(bytes, 0L) AS original_bytes",
        f"coalesce(_open_events, 0L) + {capped} AS events",
    )
    total = len(families)
    failure = _by_family({ix: f"failing OR {f.bad}" for ix, f in enumerate(families)}, "boolean", total)
    text = _by_family({ix: f.text for ix, f in enumerate(families)}, "string", total)
    separator = _by_family({ix: f.separator for ix, f in enumerate(families) if f.separator}, "string", total)
    return base.withColumn("failure", F.expr(failure)).selectExpr(
        EXEC,
        "tool",
        "if(failure, 'failure', 'success') AS status",
        f"{text} AS summary",
        *[f"{v} AS {k}" for k, v in METRICS.items()],
        "events AS event_count",
        f"{separator} AS separator",
        "original_bytes",
    )


def fold_effects(
    blocks: DataFrame, executions: DataFrame, families: Sequence[RuleFamily]
) -> DataFrame:
    """Verdicts from block rows (`fold_blocks`); `executions` gives exec_id, tool, family and
    argument."""
    named = executions.selectExpr(EXEC, "tool", family_index(families), "argument")
    return verdicts(named.join(combine_blocks(blocks, families), EXEC, "left"), families)


def fold_as(
    lines: DataFrame, family: RuleFamily, tool: str | None = None, argument: str = ""
) -> DataFrame:
    """Read every log as if `family` had produced it. `lines` are cleaned lines."""
    columns = {"tool": F.lit(tool or family.name), "fam": F.lit(0), "argument": F.lit(argument)}
    effects = line_effects(into_blocks(lines).withColumns(columns), [family])
    folded = combine_blocks(fold_blocks(effects, [family]), [family])
    return verdicts(folded.withColumns(columns), [family])


def event_parts(
    verdict: DataFrame, events: DataFrame, rows_per_part: int = 1 << 12, closing: str = "CAST(NULL AS STRING)"
) -> DataFrame:
    """The texts that list all events, as parts (exec_id, part_no, text) whose concatenation in
    order of part_no is the reference's text: part 0 is the head, each further part holds the
    events of `rows_per_part` line numbers, and the last one what comes behind them (`closing`, SQL
    over `verdict`, if it is not null). No text is put together in one cell, and no text moves by
    execution: which part is the first follows from the part numbers.

    `verdict` has exec_id, summary and separator; `events` is what `tool_events` gives."""
    listing = verdict.where("separator IS NOT NULL").selectExpr(EXEC, "summary", "separator", f"{closing} AS closing")
    numbered = events.withColumn("part_no", F.call_function("div", F.col(LINE_NO), F.lit(rows_per_part)) + 1)
    bounds = numbered.groupBy(EXEC).agg(F.min("part_no").alias("_first"), F.max("part_no").alias("_last"))
    heads = listing.join(bounds, EXEC, "left")
    keys = numbered.select(EXEC, "part_no").distinct().join(heads.select(EXEC, "separator", "_first"), EXEC)
    pieces = numbered.groupBy(EXEC, "part_no").agg(
        F.sort_array(F.collect_list(F.struct(LINE_NO, "step", "event"))).getField("event").alias("_events")
    )
    body = pieces.join(keys, [EXEC, "part_no"]).selectExpr(
        EXEC,
        "CAST(part_no AS BIGINT) AS part_no",
        "concat(if(part_no = _first, '', separator), array_join(_events, separator)) AS text",
    )
    ends = heads.selectExpr(
        EXEC,
        "inline(array(struct(0L AS part_no, summary AS text), "
        "struct(CAST(coalesce(_last, 0) + 1 AS BIGINT) AS part_no, closing AS text)))",
    ).filter("text IS NOT NULL")
    return ends.unionByName(body)
