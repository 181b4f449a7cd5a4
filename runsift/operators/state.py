"""The state of a log by blocks: one sorted pass over the text, then small mergeable rows.

The pass treats every block as if the log began with it. It marks the lines that cleaning keeps and
the runs of equal ones, and numbers both inside the block; its result is a table, which all later
steps scan with filters instead of sorting text again. What a block owes to those before it is
settled by one row for each block (`block_facts`): whether its first line repeats the last one
before it, and whether its first run goes on from an earlier block. Merging the rows of an
execution in order is one scan over short rows.

The first line of a block is the only one whose fate the block does not know. Whatever is counted
by line therefore counts that line apart (`heads_apart`), and the scan takes it or leaves it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsift.operators.blocks import (
    BLOCK,
    EXEC,
    LINE_NO,
    blocks_in_order,
    by_exec,
    earlier_blocks,
    in_block,
    in_block_so_far,
    into_blocks,
)
from runsift.operators.clean import SAMPLE_LINES, is_progress, normalize
from runsift.operators.reduce import HEAD_ROWS, IDX, MAX_ROWS, TAIL_ROWS, TOTAL, truncate_indexed
from runsift.session import as_table

Stage = Callable[[DataFrame], DataFrame]


def marked_lines(lines: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The lines of each block that stay (`kept`), and its last non-blank line in any case (`tail`).

    head: the first non-blank line of the block; rank, n: number of a kept line in its block, from
    1, and how many there are; run, runs: the same for runs of equal kept lines, from 0; length:
    lines of the run, at its last line only; bytes: of all kept lines of the block."""
    text = lines.select(EXEC, LINE_NO, normalize(F.col("line")).alias("line")).filter(F.col("line") != "")
    first = (
        into_blocks(text, block_rows)
        .withColumn("_before", F.lag("line").over(in_block()))
        .withColumn("tail", F.lead(LINE_NO).over(in_block()).isNull())
        .withColumn("head", F.col("_before").isNull())
        .withColumn("kept", (F.col("head") | (F.col("_before") != F.col("line"))) & ~is_progress(F.col("line")))
        .drop("_before")
        .filter("kept OR tail")
    )
    # Only a tail may be there without being kept, so a neighbour that is not kept is none.
    near = "CASE WHEN kept THEN line END"
    runs = (
        first.withColumn("_before", F.lag(F.expr(near)).over(in_block()))
        .withColumn("_after", F.lead(F.expr(near)).over(in_block()))
        .withColumn("_starts", F.expr("kept AND (_before IS NULL OR _before <> line)"))
        .withColumn("_ends", F.expr("kept AND (_after IS NULL OR _after <> line)"))
        .drop("_before", "_after")
    )
    whole = in_block().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        runs.withColumn("rank", F.sum(F.expr("CAST(kept AS INT)")).over(in_block_so_far()).cast("int"))
        .withColumn("run", (F.sum(F.expr("CAST(_starts AS INT)")).over(in_block_so_far()) - 1).cast("int"))
        .withColumn("n", F.sum(F.expr("CAST(kept AS INT)")).over(whole).cast("int"))
        .withColumn("runs", F.sum(F.expr("CAST(_starts AS INT)")).over(whole).cast("int"))
        .withColumn("bytes", F.sum(F.expr("CASE WHEN kept THEN octet_length(line) + 1 ELSE 0 END")).over(whole))
        .withColumn("_start", F.last(F.expr("CASE WHEN _starts THEN rank END"), ignorenulls=True).over(in_block_so_far()))
        .selectExpr(
            EXEC, BLOCK, LINE_NO, "line", "kept", "head", "tail", "rank", "n", "run", "runs", "bytes",
            "CASE WHEN _ends THEN rank - _start + 1 END AS length",
        )
    )


def block_facts(marked: DataFrame) -> DataFrame:
    """One row for each block, after one scan over the blocks of each execution.

    dropped: its first line repeats the line before; gone: that was its whole first run; merged:
    its first run goes on from an earlier block; offset, total: runs that open in earlier blocks,
    and in all; before: lines that stay in earlier blocks; n, bytes: lines and bytes that stay."""
    ends = marked.filter("tail OR (kept AND (rank = 1 OR rank = n OR (run = 0 AND length IS NOT NULL)))")
    blocks = ends.groupBy(EXEC, BLOCK).agg(
        F.expr("max(CASE WHEN head AND kept THEN line END) AS _head"),
        F.expr("max(CASE WHEN tail THEN line END) AS _tail"),
        F.expr("max(CASE WHEN kept AND rank = 1 THEN line END) AS _first"),
        F.expr("max(CASE WHEN kept AND rank = n THEN line END) AS _last"),
        F.expr("max(CASE WHEN run = 0 THEN length END) AS _length"),
        F.max("n").alias("n"),
        F.max("runs").alias("runs"),
        F.max("bytes").alias("bytes"),
    )
    settled = (
        blocks.withColumn("_before", F.lag("_tail").over(blocks_in_order()))
        .withColumn("dropped", F.expr("coalesce(_head = _before, false)"))
        .withColumn("gone", F.expr("dropped AND _length = 1"))
        .withColumn("_runs", F.expr("runs - CAST(gone AS INT)"))
        .withColumn("n", F.expr("n - CAST(dropped AS INT)"))
        .withColumn("bytes", F.expr("bytes - CASE WHEN dropped THEN octet_length(_head) + 1 ELSE 0 END"))
    )
    # A block whose first run is gone opens with another line than the one before it.
    carry = F.last(F.expr("CASE WHEN _runs > 0 THEN _last END"), ignorenulls=True).over(earlier_blocks())
    opened = settled.withColumn("_carry", carry).withColumn(
        "merged", F.expr("_runs > 0 AND NOT gone AND coalesce(_first = _carry, false)")
    ).withColumn("_opened", F.expr("CAST(_runs - CAST(merged AS INT) AS BIGINT)"))
    return opened.select(
        EXEC,
        BLOCK,
        "dropped",
        "gone",
        "merged",
        F.coalesce(F.sum("_opened").over(earlier_blocks()), F.lit(0)).alias("offset"),
        F.sum("_opened").over(by_exec()).alias("total"),
        F.coalesce(F.sum("n").over(earlier_blocks()), F.lit(0)).alias("before"),
        F.col("n").cast("bigint").alias("n"),
        F.col("bytes").cast("bigint").alias("bytes"),
    )


@dataclass(frozen=True)
class LogState:
    """What one pass over a log leaves: its marked lines and a row for each block."""

    marked: DataFrame
    facts: DataFrame

    def cleaned(self) -> DataFrame:
        """exec_id, line_no, line of every line that stays."""
        heads = self.dropped_heads()
        kept = self.marked.filter("kept")
        first = kept.filter("head").join(heads, [EXEC, BLOCK], "left_anti")
        return kept.filter("NOT head").unionByName(first).select(EXEC, LINE_NO, "line")

    def dropped_heads(self) -> DataFrame:
        """Blocks whose first line repeats the line before."""
        return self.facts.filter("dropped").select(EXEC, BLOCK)

    def samples(self, n: int = SAMPLE_LINES) -> DataFrame:
        """The first n lines of each execution: few lines of few blocks."""
        early = self.facts.filter(F.col("before") < n).select(EXEC, BLOCK, "before", "dropped")
        some = self.marked.filter(F.col("kept") & (F.col("rank") <= n + 1)).select(EXEC, BLOCK, LINE_NO, "line", "rank", "head")
        return (
            some.join(early, [EXEC, BLOCK])
            .filter("NOT (head AND dropped)")
            .filter(F.expr("before + rank - CAST(dropped AS INT)") <= n)
            .select(EXEC, LINE_NO, "line")
        )

    def compressed(self) -> DataFrame:
        """Runs with their lengths, cut to the first and last ones: (exec_id, idx, line), at most
        MAX_ROWS + 1 rows for each execution, partitioned by it.

        Every block offers only runs that may be among the first or last ones of the execution.
        A run over several blocks is put together from its parts."""
        edge = f"(run < {HEAD_ROWS + 2} OR run >= runs - {TAIL_ROWS} OR runs <= {MAX_ROWS + 2})"
        parts = (
            self.marked.filter(f"kept AND length IS NOT NULL AND {edge}")
            .select(EXEC, BLOCK, "line", "run", "length")
            .join(self.facts.select(EXEC, BLOCK, "dropped", "gone", "merged", "offset", "total"), [EXEC, BLOCK])
            .filter("NOT (gone AND run = 0)")
            .selectExpr(
                EXEC,
                f"offset + run - CAST(gone AS INT) - CAST(merged AS INT) AS {IDX}",
                "line",
                "CAST(length - CASE WHEN dropped AND run = 0 THEN 1 ELSE 0 END AS BIGINT) AS length",
                f"total AS {TOTAL}",
            )
            .filter(f"{TOTAL} <= {MAX_ROWS} OR {IDX} < {HEAD_ROWS} OR {IDX} >= {TOTAL} - {TAIL_ROWS}")
        )
        runs = (
            parts.repartition(EXEC)
            .groupBy(EXEC, IDX)
            .agg(F.max("line").alias("line"), F.sum("length").alias("_n"), F.max(TOTAL).alias(TOTAL))
            .selectExpr(
                EXEC, IDX, f"CASE WHEN _n > 1 THEN concat(line, ' (Repeated ', _n, ' times)') ELSE line END AS line", TOTAL
            )
        )
        return truncate_indexed(runs)

    def original_bytes(self) -> DataFrame:
        return self.facts.groupBy(EXEC).agg(F.sum("bytes").alias("original_bytes"))


def heads_apart(marked: DataFrame) -> DataFrame:
    """The kept lines with a block number that sets the first line of each block apart: 2 block for
    it, 2 block + 1 for the rest."""
    return marked.filter("kept").selectExpr(EXEC, f"{BLOCK} * 2 + if(head, 0, 1) AS {BLOCK}", LINE_NO, "line")


def dropped_lines(state: LogState) -> DataFrame:
    """The blocks of `heads_apart` that hold a dropped line."""
    return state.dropped_heads().selectExpr(EXEC, f"{BLOCK} * 2 AS {BLOCK}")


def log_state(lines: DataFrame, stage: Stage = as_table, block_rows: int | None = None) -> LogState:
    """One pass over (exec_id, line_no, line); `stage` keeps the two tables for their readers."""
    marked = stage(marked_lines(lines, block_rows))
    return LogState(marked, stage(block_facts(marked)))
