"""Ordered work inside one execution, without one task per execution.

A single execution may hold a large share of all rows, so nothing here may sort or collect a
whole execution in one task. Lines are cut into blocks of consecutive line numbers and spread
by (exec_id, block). Ordered logic runs inside a block; what must flow from one block to the
next is reduced to one summary row per block, scanned over the blocks of the execution, and
joined back on (exec_id, block). The join finds its big side already hash-partitioned and
sorted on these keys, so only the summary rows move.

Line text is shuffled once. Block summaries are `ceil(lines / BLOCK_ROWS)` rows per execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EXEC = "exec_id"
LINE_NO = "line_no"
BLOCK = "_block"
BLOCK_ROWS = 1 << 16


def by_exec() -> WindowSpec:
    return Window.partitionBy(EXEC)


def blocks_in_order() -> WindowSpec:
    return by_exec().orderBy(BLOCK)


def earlier_blocks() -> WindowSpec:
    return blocks_in_order().rowsBetween(Window.unboundedPreceding, -1)


def in_block() -> WindowSpec:
    return Window.partitionBy(EXEC, BLOCK).orderBy(LINE_NO)


def in_block_so_far() -> WindowSpec:
    return in_block().rowsBetween(Window.unboundedPreceding, 0)


def block_of(position: Column, block_rows: int | None = None) -> Column:
    """Block number of a line position. Never null, so that no join adds null filters to one
    branch only (that would stop Spark from reusing the exchange)."""
    return F.coalesce(F.call_function("div", position, F.lit(block_rows or BLOCK_ROWS)), F.lit(0).cast("bigint"))


def into_blocks(lines: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Spread lines by (exec_id, block): the one shuffle of line text. No-op if done before."""
    if BLOCK in lines.columns:
        return lines
    return (
        lines.filter(F.col(EXEC).isNotNull() & F.col(LINE_NO).isNotNull())
        .withColumn(BLOCK, block_of(F.col(LINE_NO), block_rows))
        .repartition(EXEC, BLOCK)
    )


def previous_line(lines: DataFrame, column: str = "line", out: str = "_prev") -> DataFrame:
    """Add the value of `column` on the previous row of the same execution (null on the first)."""
    lines = into_blocks(lines)
    tails = lines.groupBy(EXEC, BLOCK).agg(F.max_by(column, LINE_NO).alias("_tail"))
    carry = tails.select(EXEC, BLOCK, F.lag("_tail").over(blocks_in_order()).alias("_carry"))
    return (
        lines.withColumn("_lag", F.lag(column).over(in_block()))
        .join(carry, [EXEC, BLOCK])
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_lag", "_carry")
    )


def with_position(lines: DataFrame, position: str = "_pos", total: str | None = None) -> DataFrame:
    """Add the 1-based position of a row in its execution and, on request, the row count."""
    lines = into_blocks(lines)
    counts = lines.groupBy(EXEC, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    scans = [F.coalesce(F.sum("_n").over(earlier_blocks()), F.lit(0)).alias("_offset")]
    if total:
        scans.append(F.sum("_n").over(by_exec()).alias(total))
    return (
        lines.withColumn("_rank", F.row_number().over(in_block()))
        .join(counts.select(EXEC, BLOCK, *scans), [EXEC, BLOCK])
        .withColumn(position, F.col("_offset") + F.col("_rank"))
        .drop("_offset", "_rank")
    )


def number_rows(
    rows: DataFrame, key: str, slices: list[Column], order: list[str], out: str = LINE_NO
) -> DataFrame:
    """Number the rows of each key from 0 in `order`, however many rows a key has.

    `slices` cut a key from coarse to fine and must not decrease along `order`. Rows are ranked
    inside the finest slice and shifted by the size of the earlier slices, which are counted
    from the slice columns alone and combined before their shuffle.
    """
    names = [f"_s{i}" for i in range(len(slices))]
    sliced = rows.withColumns(dict(zip(names, slices)))
    sizes = sliced.groupBy(key, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(len(names), 0, -1):
        outer, inner = [key, *names[: depth - 1]], names[depth - 1]
        earlier = (
            Window.partitionBy(*outer).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
        )
        level = sizes.groupBy(*outer, inner).agg(F.sum("_n").alias("_n"))
        shift = level.select(
            *outer, inner, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
        )
        if offsets is None:
            offsets = shift.withColumnRenamed("_shift", "_offset")
        else:
            offsets = (
                offsets.join(shift, [*outer, inner])
                .withColumn("_offset", F.col("_offset") + F.col("_shift"))
                .drop("_shift")
            )
    return (
        sliced.repartition(key, *names)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(key, *names).orderBy(*order)))
        .join(offsets, [key, *names])
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_rank", "_offset", *names)
    )
