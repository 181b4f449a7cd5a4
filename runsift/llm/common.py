"""Reading tables, shared intermediate tables and numbering, used by several operators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsift.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; another path may be given wherever this is used."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder of the session: it cuts the lineage, and a lost
    executor does not take it away."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table made by `written` that nothing reads any more, as the earlier rounds of a loop."""
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def whole_text(column: str = "text") -> Column:
    """The text; a null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


def beside_text(docs: DataFrame, kept: Sequence[str], text: str) -> tuple[DataFrame, int]:
    """The kept columns for a Python worker, and the place of the text among them: the text goes
    along once, whether it is kept or not. A null text stays null."""
    if text in kept and dict(docs.dtypes)[text] == "string":
        return docs.select(*kept), list(kept).index(text)
    return docs.select(*kept, F.col(text).cast("string").alias(free_name(docs, "whole"))), len(kept)


#: Short rows (a few numbers each) that may be sent to all executors instead of shuffling texts.
SENT_ROWS = 400_000


def sent(small: DataFrame, weight: Column | None = None, limit: int = SENT_ROWS) -> DataFrame:
    """small with a broadcast hint if it has at most `limit` rows, or the sum of `weight` over its
    rows is at most that; beyond, the join is left to shuffles. Counts small, so pass a written
    table."""
    total = small.agg(F.sum(weight) if weight is not None else F.count("*")).first()[0] or 0
    return F.broadcast(small) if total <= limit else small


#: A key of at least one in so many rows is hot: there are at most HOT such keys.
HOT = 100_000


def joined_by_parts(rows: DataFrame, table: DataFrame, on: Sequence[str], hot: Column) -> DataFrame:
    """rows joined to a table with one row for each key. Rows of hot keys get theirs by broadcast
    and do not move, so that a key that many rows share is no load of one task; `hot`, a condition
    on the table, must hold for few keys only. Both are read twice: pass written tables."""
    hit = free_name(rows, "hit")
    few = F.broadcast(table.where(hot).withColumn(hit, F.lit(True)))
    tagged = rows.join(few, list(on), "left")
    values = [c for c in table.columns if c not in on]
    others = tagged.where(F.col(hit).isNull()).drop(hit, *values).join(table.where(~hot), list(on))
    return tagged.where(hit).drop(hit).unionByName(others)


def has_plain_key(docs: DataFrame, key: str) -> bool:
    """Whether the key names each row: no nulls and no repeats."""
    return not docs.groupBy(F.col(key).alias("k")).count().where("`count` > 1 or k is null").limit(1).count()


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """The record batches of a task in small pieces, so that a Python worker holds few texts, and
    what it makes of them, at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 8) -> int:
    """Number of buckets that grows with the rows, so that one bucket stays about the same."""
    return max(least, math.ceil(rows / per_bucket))


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int, name: str
) -> DataFrame:
    """Adds a gapless 0-based number `name` within `keys` (the whole table if empty), without
    bringing all rows of a key together.

    Rows are ordered by (hash bucket of the first `order` column, `order`). Only the counts of
    the buckets, at most keys x buckets rows, are summed up in one window per key. Rows that are
    equal in all of `order` get consecutive numbers in no fixed order."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(order[0])), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    on = F.col("_bucket") == F.col("_o_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(within))
        .join(offsets, on, "left")
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_offset", "_o_bucket", *[f"_o_{k}" for k in keys])
    )
