"""Log reduction: run-length encoding, head/tail truncation, noise filter, result grouping.

Up to the truncation an execution may be of any length, so these steps work in blocks. After
it an execution has at most MAX_ROWS + 1 rows, and plain windows per execution are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.functions.text import matches, startswith_any, trim
from runsift.operators.blocks import (
    BLOCK,
    blocks_in_order,
    by_exec,
    earlier_blocks,
    EXEC,
    in_block,
    in_block_so_far,
    LINE_NO,
    into_blocks,
    previous_line,
    with_position,
)

# Limits, marker and result-line patterns.
MAX_ROWS = 800
HEAD_ROWS = 300
TAIL_ROWS = 500
TRUNCATION_MARKER = "... [TRUNCATED: LOG TOO LONG] ..."
PASS_PATTERN = r"^(?i)(?:\x{2713}|PASS|ok)\s+(.*)"
FAIL_PATTERN = r"^(?i)(?:\x{2717}|FAIL)\s+(.*)"

IDX = "idx"
TOTAL = "_total"


def rle_lines(lines: DataFrame, keep_total: bool = False) -> DataFrame:
    """One row per run of equal lines: `line (Repeated n times)` for n > 1, else the line.

    A run may cross blocks. Per block we need its row count, first and last line, the place
    where its last inner run starts and how many runs end inside it; the rest follows from a
    scan over these summaries. Positions, run lengths and run numbers then are arithmetic.
    """
    text = lines.withColumn("line", trim(F.col("line"))).filter(F.col("line") != "")
    rows = (
        into_blocks(text)
        .withColumn("_i", F.row_number().over(in_block()))
        .withColumn("_before", F.lag("line").over(in_block()))
        .withColumn("_after", F.lead("line").over(in_block()))
        .withColumn("_starts", F.col("_before") != F.col("line"))
        .withColumn("_ends", F.col("_after") != F.col("line"))
    )
    blocks = (
        rows.groupBy(EXEC, BLOCK)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by("line", LINE_NO).alias("_head"),
            F.max_by("line", LINE_NO).alias("_tail"),
            F.max(F.when(F.col("_starts"), F.col("_i"))).alias("_last_start"),
            F.count_if("_ends").alias("_inner_ends"),
        )
        .withColumn("_prev_tail", F.lag("_tail").over(blocks_in_order()))
        .withColumn("_next_head", F.lead("_head").over(blocks_in_order()))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier_blocks()), F.lit(0)))
        .withColumn("_opens", F.col("_prev_tail").isNull() | (F.col("_prev_tail") != F.col("_head")))
        .withColumn("_closes", F.col("_next_head").isNull() | (F.col("_next_head") != F.col("_tail")))
        .withColumn(
            "_start_here",
            F.when(F.col("_last_start").isNotNull(), F.col("_offset") + F.col("_last_start")).when(
                F.col("_opens"), F.col("_offset") + 1
            ),
        )
        .withColumn("_runs", F.col("_inner_ends") + F.col("_closes").cast("bigint"))
        .select(
            EXEC,
            BLOCK,
            "_offset",
            "_opens",
            "_closes",
            F.last("_start_here", ignorenulls=True).over(earlier_blocks()).alias("_start_carry"),
            F.coalesce(F.sum("_runs").over(earlier_blocks()), F.lit(0)).alias("_run_offset"),
            F.sum("_runs").over(by_exec()).alias(TOTAL),
        )
    )
    start = F.coalesce(
        F.col("_offset") + F.col("_inner_start"),
        F.when(F.col("_opens"), F.col("_offset") + 1),
        F.col("_start_carry"),
    )
    length = F.col("_offset") + F.col("_i") - start + 1
    runs = (
        rows.withColumn(
            "_inner_start",
            F.last(F.when(F.col("_starts"), F.col("_i")), ignorenulls=True).over(in_block_so_far()),
        )
        .withColumn("_ended", F.sum(F.col("_ends").cast("bigint")).over(in_block_so_far()))
        .join(blocks, [EXEC, BLOCK])
        .filter(F.when(F.col("_after").isNull(), F.col("_closes")).otherwise(F.col("_ends")))
        .select(
            EXEC,
            (
                F.col("_run_offset")
                + F.coalesce("_ended", F.lit(0))
                + F.col("_after").isNull().cast("bigint")
                - 1
            ).alias(IDX),
            F.when(
                length > 1,
                F.concat("line", F.lit(" (Repeated "), length.cast("string"), F.lit(" times)")),
            )
            .otherwise(F.col("line"))
            .alias("line"),
            TOTAL,
        )
    )
    return runs if keep_total else runs.drop(TOTAL)


def index_lines(lines: DataFrame) -> DataFrame:
    """Dense 0-based `idx` and the row count of the execution, for an unbounded table."""
    return with_position(lines, "_pos", TOTAL).select(
        EXEC, (F.col("_pos") - 1).alias(IDX), "line", TOTAL
    )


def truncate_indexed(
    rows: DataFrame, max_rows: int = MAX_ROWS, head: int = HEAD_ROWS, tail: int = TAIL_ROWS
) -> DataFrame:
    """Keep the first `head` and last `tail` rows of executions above `max_rows`, with a marker
    row between. Row-local: position and total are already on each row."""
    idx, total = F.col(IDX), F.col(TOTAL)
    long = total > max_rows
    in_head, in_tail = idx < head, idx >= total - tail
    # The two ranges overlap only if head + tail > total; then a row is emitted twice.
    copies = F.when(~long, F.array(F.struct(idx.alias(IDX), F.col("line")))).otherwise(
        F.filter(
            F.array(
                F.when(in_head, F.struct(idx.alias(IDX), F.col("line"))),
                F.when(
                    idx == head - 1,
                    F.struct(
                        F.lit(head).cast("bigint").alias(IDX), F.lit(TRUNCATION_MARKER).alias("line")
                    ),
                ),
                F.when(
                    in_tail,
                    F.struct((idx - (total - tail) + head + 1).alias(IDX), F.col("line")),
                ),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return (
        rows.filter(~long | in_head | in_tail)
        .select(EXEC, F.explode(copies).alias("_row"))
        .select(EXEC, F.col(f"_row.{IDX}").alias(IDX), F.col("_row.line").alias("line"))
    )


def truncate_head_tail(
    lines: DataFrame, max_rows: int = MAX_ROWS, head: int = HEAD_ROWS, tail: int = TAIL_ROWS
) -> DataFrame:
    return truncate_indexed(index_lines(lines), max_rows, head, tail)


def compress_lines(lines: DataFrame) -> DataFrame:
    """Runs, then truncation: at most MAX_ROWS + 1 rows per execution come out."""
    return truncate_indexed(rle_lines(lines, keep_total=True))


def is_dependency_noise(line: Column) -> Column:
    low = F.lower(line)
    return (low.contains("node_modules") & low.contains("warning")) | startswith_any(
        low, "[info] downloading", "[info] fetching"
    )


def filter_dep_noise(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_dependency_noise(trim(F.col("line"))))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse each segment (result lines up to and including the next normal line)."""
    passed = F.count_if("_pass")
    failed = F.count_if("_fail")
    closing = F.max(F.when(~F.col("_pass") & ~F.col("_fail"), F.col("line")))
    segments = rows.groupBy(*keys, "_seg").agg(
        passed.alias("_p"), failed.alias("_f"), closing.alias("_line")
    )
    return segments


def _emit(segments: DataFrame, order: str = "_seg") -> DataFrame:
    texts = F.filter(
        F.array(
            F.when(
                F.col("_p") > 0,
                F.concat(F.lit("✓ "), F.col("_p").cast("string"), F.lit(" tests passed")),
            ),
            F.when(
                F.col("_f") > 0,
                F.concat(F.lit("✗ "), F.col("_f").cast("string"), F.lit(" tests failed")),
            ),
            F.col("_line"),
        ),
        lambda x: x.isNotNull(),
    )
    return segments.select(EXEC, F.col(order).alias("_seg"), F.posexplode(texts).alias("_k", "line"))


def _classified(rows: DataFrame) -> DataFrame:
    passes = matches(F.col("line"), PASS_PATTERN)
    fails = matches(F.col("line"), FAIL_PATTERN)
    return rows.withColumn("_pass", passes).withColumn("_fail", ~F.col("_pass") & fails)


def group_pass_fail(lines: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Replace runs of result lines by their counts, for executions of any length.

    Lines stay where their block is. A normal line knows the results since the normal line before
    it in the block; only the first one of a block is completed, from one row per block: the
    results up to the last normal line of earlier blocks. Numbers of rows are sums over blocks and
    inside the block."""
    text = lines.withColumn("line", trim(F.col("line"))).filter(F.col("line") != "")
    so_far = in_block_so_far()
    before = in_block().rowsBetween(Window.unboundedPreceding, -1)
    counted = _classified(into_blocks(text, block_rows)).withColumn("_normal", ~F.col("_pass") & ~F.col("_fail"))
    for kind in ("_pass", "_fail"):
        counted = counted.withColumn(f"_all{kind}", F.sum(F.col(kind).cast("bigint")).over(so_far))
    for kind in ("_pass", "_fail"):
        # Results up to the normal line before, and since it.
        last = F.last(F.when(F.col("_normal"), F.col(f"_all{kind}")), ignorenulls=True).over(before)
        counted = counted.withColumn(f"_n{kind}", F.col(f"_all{kind}") - F.coalesce(last, F.lit(0)))
    rows = "1 + CAST({0}_pass > 0 AS INT) + CAST({0}_fail > 0 AS INT)"
    first = F.coalesce(F.sum(F.col("_normal").cast("bigint")).over(before), F.lit(0)) == 0
    counted = counted.withColumn("_first", F.col("_normal") & first).withColumn(
        "_rows", F.expr(f"CASE WHEN _normal AND NOT _first THEN {rows.format('_n')} ELSE 0 END")
    )
    blocks = counted.groupBy(EXEC, BLOCK).agg(
        F.max("_normal").alias("_any"),
        F.sum("_rows").alias("_inner"),
        *[F.max(f"_all{k}").alias(f"_total{k}") for k in ("_pass", "_fail")],
        *[F.max(F.when(F.col("_normal"), F.col(f"_all{k}"))).alias(f"_last{k}") for k in ("_pass", "_fail")],
        *[F.max(F.when(F.col("_first"), F.col(f"_n{k}"))).alias(f"_lead{k}") for k in ("_pass", "_fail")],
    )
    for k in ("_pass", "_fail"):
        blocks = (
            blocks.withColumn(f"_past{k}", F.coalesce(F.sum(f"_total{k}").over(earlier_blocks()), F.lit(0)))
            .withColumn(f"_at{k}", F.expr(f"CASE WHEN _any THEN _past{k} + _last{k} END"))
            .withColumn(
                f"_first{k}",
                F.col(f"_past{k}")
                + F.col(f"_lead{k}")
                - F.coalesce(F.last(f"_at{k}", ignorenulls=True).over(earlier_blocks()), F.lit(0)),
            )
        )
    blocks = blocks.withColumn("_head", F.expr(f"CASE WHEN _any THEN {rows.format('_first')} ELSE 0 END"))
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum(F.expr("_head + _inner")).over(earlier_blocks()), F.lit(0)))
    own = ["_head", "_offset", "_first_pass", "_first_fail"]
    inner = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    placed = (
        counted.withColumn("_inner", inner)
        .filter("_normal")
        .select(EXEC, BLOCK, "line", "_first", "_inner", "_n_pass", "_n_fail")
        .join(blocks.select(EXEC, BLOCK, *own), [EXEC, BLOCK])
        .selectExpr(
            EXEC,
            "_offset + if(_first, 0, _head + _inner) AS _seg",
            "if(_first, _first_pass, _n_pass) AS _p",
            "if(_first, _first_fail, _n_fail) AS _f",
            "line AS _line",
        )
    )
    # What follows the last normal line of an execution.
    ends = blocks.groupBy(EXEC).agg(
        F.sum(F.expr("_head + _inner")).alias("_seg"),
        *[
            (F.sum(f"_total{k}") - F.coalesce(F.max(f"_at{k}"), F.lit(0))).alias(n)
            for k, n in (("_pass", "_p"), ("_fail", "_f"))
        ],
        F.lit(None).cast("string").alias("_line"),
    )
    emitted = _emit(placed.unionByName(ends))
    return emitted.select(EXEC, (F.col("_seg") + F.col("_k")).cast("bigint").alias(IDX), "line")


def optimize_bounded(rows: DataFrame) -> DataFrame:
    """Noise filter, second dedupe and result grouping over rows (exec_id, idx, line) that are
    bounded per execution. One exchange on exec_id serves every window and aggregate."""
    by_idx = by_exec().orderBy(IDX)
    seen = (
        rows.withColumn("line", trim(F.col("line")))
        .filter((F.col("line") != "") & ~is_dependency_noise(F.col("line")))
        .withColumn("_prev", F.lag("line").over(by_idx))
        .filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("line")))
        .drop("_prev")
    )
    segmented = (
        _classified(seen)
        .withColumn("_normal", (~F.col("_pass") & ~F.col("_fail")).cast("bigint"))
        .withColumn(
            "_seg",
            F.sum("_normal").over(by_idx.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_normal"),
        )
    )
    emitted = _emit(_grouped(segmented, [EXEC]))
    return emitted.select(
        EXEC,
        (F.row_number().over(by_exec().orderBy("_seg", "_k")) - 1).cast("bigint").alias(IDX),
        "line",
    )


def reduce_lines(cleaned: DataFrame) -> DataFrame:
    """The whole reduction of cleaned lines: dense `idx`, at most MAX_ROWS + 1 rows."""
    return optimize_bounded(compress_lines(cleaned))


def dedupe_surviving(lines: DataFrame) -> DataFrame:
    """Noise filter and dedupe against the last surviving line, for any length."""
    quiet = filter_dep_noise(lines.withColumn("line", trim(F.col("line")))).filter(
        F.col("line") != ""
    )
    prev = previous_line(quiet)
    return prev.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("line"))).drop(
        "_prev", BLOCK
    )
