"""Exact top-k inner products with bounds from segment statistics at several resolutions.

A vector is cut into equal segments. Within a segment the inner product of two vectors is at most
length * (mean * mean + deviation * deviation), the twin of the lower bound that means and
deviations give for the distance. Scaled by the root of the length, means and deviations of all
segments make a short vector, and the bound is its inner product: 2 numbers for one segment, 8 for
four, 32 for sixteen, 64 for thirty-two. Pairs that the coarse bound leaves go to the finer ones,
and only survivors of all are computed exactly: in doubles while all sums are below 2^53, where
whole numbers are exact, else in integers.

A pair survives if its bound reaches the query's threshold, the k-th best exact score among a first
set of rows (a bounded sample, the same for all blocks) and among the block's best bounds. While
many pairs of a block survive, products are taken for the whole block at once, which is far cheaper
for each; when few are left, one by one. A level that would be no cheaper than exact products is
left out. Vectors without structure give the bounds little to hold on to (README has figures): then
nearly all pairs are computed exactly.

Queries and candidates are packed into blocks of bounded size, and each pair of blocks is one row
of work: no task holds more than a few blocks, and each gives at most k rows for a query. Pairs are
made where the candidates are: a copy of each query block for every block of candidates would grow
with their product. The query blocks are sent there, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.llm.common import buckets_for, written

#: Vectors in a block.
QUERY_BLOCK, ROW_BLOCK = 256, 4096
#: Segments at each resolution; 0 stands for exact.
LEVELS = (1, 4, 16, 32)
#: Rows that give the first thresholds; share of pairs from which products go by whole blocks.
FIRST_ROWS, DENSE = 2048, 0.02
#: Numbers of query vectors that are sent to the rows at a time, but one block at least; blocks in a
#: file, and row blocks of a task.
SENT_NUMBERS, TASK_BLOCKS = 1 << 22, 8


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null for a vector that takes no part:
    null, or with a null or non-finite component."""
    ok = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def features(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that inner products bound those of the rows.
    Vectors that the segments do not divide are filled up with zeros, which changes nothing."""
    n, d = rows.shape
    width = max(1, -(-d // segments))
    full = np.zeros((n, width * segments))
    full[:, :d] = rows
    parts = full.reshape(n, segments, width)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(width)


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of queries[q[k]] and rows[r[k]]."""
    step = 1 << 16
    parts = [np.einsum("ij,ij->i", queries[q[at : at + step]], rows[r[at : at + step]]) for at in range(0, len(q), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fits_doubles(queries: np.ndarray, rows: np.ndarray) -> bool:
    """Whether all sums of products are whole numbers that doubles hold exactly."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0))
    return most * max(queries.shape[1], 1) < 1 << 53


def all_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if fits_doubles(queries, rows):
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    q, r = np.indices((len(queries), len(rows))).reshape(2, -1)
    return exact(queries, rows, q, r).reshape(len(queries), len(rows))


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest value of each row; -inf if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def thresholds(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Scores that the k best of each query reach at least, from some of the rows."""
    scores = all_scores(queries, rows).astype(float)
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    return kth_best(scores, k)


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None):
    """(query number, row number, score) of the k best rows of each query, among those that reach
    `least`; a query's own row takes no part; ties go to the smaller id."""
    none = np.empty(0, np.int64)
    if not len(queries) or not len(rows):
        return none, none, none
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    width = rows.shape[1]
    # Rounding in the bounds is far below this share of the largest value.
    slack = 1e-9 * (1 + np.abs(queries).max(initial=0) * float(np.abs(rows).max(initial=0)) * max(width, 1))
    least = np.full(len(queries), -np.inf) if least is None else least.copy()
    left = q_ids[:, None] != ids[None, :]
    for n, segments in enumerate(LEVELS):
        if n and 2 * segments >= width:
            break
        fine_q, fine_r = features(queries, segments), features(rows, segments)
        if left.mean() > DENSE:
            bound = fine_q @ fine_r.T
            if not n:
                # Exact scores of the rows with the best bounds raise the thresholds.
                first = min(len(rows), 4 * k + 4)
                top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
                q = np.repeat(np.arange(len(queries)), first)
                seen = exact(queries, rows, q, top.ravel()).reshape(len(queries), first).astype(float)
                seen[~np.take_along_axis(left, top, axis=1)] = -np.inf
                least = np.maximum(least, kth_best(seen, k))
            left &= bound >= least[:, None] - slack
        else:
            q, r = np.nonzero(left)
            bound = np.einsum("ij,ij->i", fine_q[q], fine_r[r])
            left[q, r] = bound >= least[q] - slack
    q, r = np.nonzero(left)
    if left.mean() > DENSE and fits_doubles(queries, rows):
        score = all_scores(queries, rows)[q, r]
    else:
        score = exact(queries, rows, q, r)
    reach = score >= least[q]
    q, r, score = q[reach], r[reach], score[reach]
    ranked = np.lexsort((r, -score, q))
    q, r, score = q[ranked], r[ranked], score[ranked]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else none
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    chosen = place < k
    return q[chosen], order[r[chosen]], score[chosen]


def _tasks(df: DataFrame, blocks: int, waves: int) -> int:
    """Tasks for so many blocks: enough for all cores, and few blocks in each."""
    return max(1, min(blocks, max(waves * df.sparkSession.sparkContext.defaultParallelism, blocks // TASK_BLOCKS)))


def _packed(vectors: DataFrame, rows_per_block: int, name: str) -> DataFrame:
    """One row for each block: its ids and its components one after the other, filled up with
    zeros to `width`."""
    blocks = buckets_for(vectors.count(), rows_per_block // 2, 1)
    return (
        vectors.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        # A reader holds as many blocks of a file as there are.
        .repartition(_tasks(vectors, blocks, 1), name)
        .groupBy(name)
        .agg(F.collect_list(F.struct("id", "v")).alias("m"), F.max(F.size("v")).alias("width"))
        .select(name, F.col("m.id").alias(f"{name}_ids"), F.col("m.v").alias(f"{name}_v"), F.col("width").alias(f"{name}_w"))
    )


def _groups(blocks: DataFrame) -> list[list[int]]:
    """The numbers of the query blocks, in groups that may be sent to all executors; one empty group
    if there are none."""
    size = F.size("q_ids").cast("bigint") * (F.coalesce("q_w", F.lit(0)) + 2)
    groups, room = [[]], SENT_NUMBERS
    for q, numbers in blocks.select("q", size).orderBy("q").collect():
        if groups[-1] and numbers > room:
            groups.append([])
            room = SENT_NUMBERS
        groups[-1].append(q)
        room -= numbers
    return groups


def top_k(
    queries: DataFrame, rows: DataFrame, k: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), the row's key, score: the k highest inner products of the integer
    vectors floor(scale * x), for each query against all rows but those with its own key.

    Vectors of different lengths are compared as if the shorter one went on with zeros. Vectors
    that are null or hold null or non-finite components take no part, nor do rows with a null
    key. Rows that repeat a key are separate rows; as queries they are one, the largest vector.
    Scores beyond 64 bits are not defined."""
    def clean(df: DataFrame) -> DataFrame:
        return (
            df.select(F.col(key).cast("bigint").alias("id"), scaled(F.col(vector), scale).alias("v"))
            .where("id is not null and v is not null")
        )

    left = written(_packed(clean(queries).groupBy("id").agg(F.max("v").alias("v")), QUERY_BLOCK, "q"), "topk-queries")
    right = written(_packed(clean(rows), ROW_BLOCK, "r"), "topk-rows")
    # At most FIRST_ROWS vectors.
    some = clean(rows).orderBy(F.xxhash64("id"), "id", "v").limit(FIRST_ROWS).collect()
    some_width = max((len(row["v"]) for row in some), default=0)
    some_ids = np.array([row["id"] for row in some], np.int64)
    some_rows = np.array([row["v"] + [0] * (some_width - len(row["v"])) for row in some], np.int64).reshape(len(some), some_width)

    def matrix(ids, flat, width: int) -> np.ndarray:
        values, ends = flat.flatten().to_numpy(zero_copy_only=False), np.asarray(flat.value_lengths())
        if len(set(ends.tolist())) == 1 and ends[0] == width:
            return values.reshape(len(ids), width)
        out = np.zeros((len(ids), width), np.int64)
        at = 0
        for row, n in enumerate(ends):
            out[row, :n] = values[at : at + n]
            at += n
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("q_ids", "q_v", "r_ids", "r_v", "q_w", "r_w", "q_least")]
            for at in range(batch.num_rows):
                q_ids, q_v, r_ids, r_v = (c.slice(at, 1).flatten() for c in columns[:4])
                width = max(1, columns[4][at].as_py() or 0, columns[5][at].as_py() or 0)
                q_ids, r_ids = q_ids.to_numpy(zero_copy_only=False), r_ids.to_numpy(zero_copy_only=False)
                q, r, score = best(matrix(q_ids, q_v, width), q_ids, matrix(r_ids, r_v, width), r_ids, k, columns[6].slice(at, 1).flatten().to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[q]), pa.array(r_ids[r]), pa.array(score)], names=["query_id", "id", "score"]
                )

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for at in range(batch.num_rows):
                ids, flat = (batch.column(n).slice(at, 1).flatten() for n in ("q_ids", "q_v"))
                width = max(1, batch.column("q_w")[at].as_py() or 0, some_width)
                wide = np.zeros((len(some_rows), width), np.int64)
                wide[:, :some_width] = some_rows
                q_ids = ids.to_numpy(zero_copy_only=False)
                least.append(thresholds(matrix(q_ids, flat, width), q_ids, wide, some_ids, k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.float64()))], names=[*batch.schema.names, "q_least"])

    more = T.StructType([*left.schema.fields, T.StructField("q_least", T.ArrayType(T.DoubleType()))])
    left = written(left.mapInArrow(started, more), "topk-started")

    spread = right.repartition(_tasks(right, right.count(), 4), "r")
    found = None
    groups = _groups(left)
    for n, group in enumerate(groups):
        cells = spread.crossJoin(F.broadcast(left.where(F.col("q").isin(group))))
        part = cells.select("q_ids", "q_v", "r_ids", "r_v", "q_w", "r_w", "q_least").mapInArrow(
            search, "query_id bigint, id bigint, score bigint"
        )
        # One group is sent after the other: those of one plan would be held at the same time.
        part = written(part, "topk-found") if len(groups) > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )
