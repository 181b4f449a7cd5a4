"""Listing and keyword search over the execution history."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsift.session import as_table

SEARCHED = ("command", "summary", "status")


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows from 1 in `order`, ties in any order.

    Rows move once, into ranges of the order with bounds from a sample; a range is numbered inside,
    and shifted by the rows of the ranges before it. The result is stored in between, because a
    second evaluation could cut the ranges elsewhere."""
    inside = F.monotonically_increasing_id()
    ranged = as_table(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # The id holds the number of the partition and, below bit 33, that of the row in it.
        .withColumn("_range", F.shiftright(inside, 33))
        .withColumn("_row", inside.bitwiseAND((1 << 33) - 1)),
        "ranges",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    shifts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    return (
        ranged.join(F.broadcast(shifts), "_range")
        .withColumn(out, F.col("_shift") + F.col("_row") + 1)
        .drop("_range", "_row", "_shift")
    )


def history_list(history: DataFrame) -> DataFrame:
    """Every entry in append order (ts, execution_id) with its number from 1."""
    return numbered(history, ["ts", "execution_id"], "entry_no")


def _words(query: str) -> list[str]:
    return sorted(set(query.lower().split()))


def _hit(query: str) -> Column:
    out = F.lit(False)
    for word in _words(query):
        for name in SEARCHED:
            out = out | F.lower(name).contains(word)
    return out


def history_search(history: DataFrame, query: str) -> DataFrame:
    """Entries in which any word of the query occurs; none for an empty query. Row-local."""
    return history.filter(_hit(query))


def history_search_many(history: DataFrame, queries: Mapping[str, str]) -> DataFrame:
    """Several named searches in one pass: a row per entry and matching query. The queries are
    known when the plan is built, so this needs no join."""
    hits = F.array(*[F.when(_hit(q), F.lit(name)) for name, q in queries.items()])
    return history.withColumn("query_id", F.explode(hits)).filter(F.col("query_id").isNotNull())


@dataclass(frozen=True)
class HistoryIndex:
    """Entries in blocks of their order, and for every string of `gram` characters the blocks in
    which it occurs. A word can only occur where all its grams do: a search reads the blocks that
    remain and looks at their entries; words shorter than a gram are searched for in all."""

    spark: SparkSession
    path: str
    gram: int = 3
    #: Blocks that go into the filter of the scan; beyond, entries are joined to them.
    most_blocks: int = 5_000

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def blocks_of(self, query: str) -> DataFrame | None:
        """The blocks (`block`, each once) where a word of the query may occur; None: any."""
        words = _words(query)
        if any(len(w) < self.gram for w in words):
            return None
        grams = sorted({(w, w[i : i + self.gram]) for w in words for i in range(len(w) - self.gram + 1)})
        if not grams:
            return self.postings.select("block").limit(0)
        wanted = self.spark.createDataFrame(grams, "word string, gram string")
        needed = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("needed"))
        # The postings are ordered by gram, so the list prunes their scan.
        listed = self.postings.where(F.col("gram").isin(sorted({g for _, g in grams})))
        return (
            listed.join(F.broadcast(wanted), "gram")
            .groupBy("word", "block")
            .agg(F.count(F.lit(1)).alias("n"))
            .join(F.broadcast(needed), "word")
            .where("n = needed")
            .select("block")
            .distinct()
        )

    def candidates(self, query: str) -> DataFrame:
        """The entries that a search looks at."""
        blocks = self.blocks_of(query)
        if blocks is None:
            return self.entries
        some = [row["block"] for row in blocks.limit(self.most_blocks + 1).collect()]
        if len(some) > self.most_blocks:
            return self.entries.join(blocks, "block", "left_semi")
        return self.entries.where(F.col("block").isin(some)) if some else self.entries.limit(0)

    def search(self, query: str) -> DataFrame:
        """What `history_search` finds, in the columns of the history."""
        return history_search(self.candidates(query), query).drop("block")


def build_history_index(history: DataFrame, path: str, gram: int = 3, block_rows: int = 4096) -> HistoryIndex:
    """Write the index of a history (with ts and execution_id) to a new folder."""
    spark = history.sparkSession
    entries = numbered(history, ["ts", "execution_id"], "_no").withColumn(
        "block", F.floor((F.col("_no") - 1) / block_rows).cast("bigint")
    ).drop("_no")
    # The ranges of the numbering are the order of the files: a block is in one or two of them.
    entries.write.parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")

    def grams_of(text: str) -> str:
        places = f"sequence(1, length({text}) - {gram - 1})"
        pieces = f"transform({places}, i -> substring({text}, i, {gram}))"
        return f"CASE WHEN length({text}) >= {gram} THEN {pieces} ELSE CAST(array() AS array<string>) END"

    grams = F.expr(f"flatten(array({', '.join(grams_of(f'lower({name})') for name in SEARCHED)}))")
    pairs = stored.select("block", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
    pairs.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")
    return HistoryIndex(spark, path, gram)
