"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams of the lower-case text that occur in it (present or
not), each scaled by r = log of the smoothed ratio of its shares in toxic and clean documents; a
logistic regression on the scaled features gives the probability. Only the text is an input.

The fit takes a bounded, documented sample of labelled documents: for each label the `per_label`
ones with the smallest hash of their id. Class weights put back the true share of toxic documents
among all labelled ones. Counting of n-grams and choice of features run in Spark; the driver gets
at most FEATURES counts and the chosen features of the sample. Scoring covers every whole text.

Null and empty texts get the score of a text without any feature. Without labels the score is 0;
with one label only, the score is that label's share after smoothing. A document that is labelled
twice is toxic if any of its labels says so; null labels are not used. Of rows that repeat a
doc_id the fit takes the least text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.llm.common import beside_text, slices, whole_text, written

#: Lengths of the n-grams, bits of their hash, n-grams that take part in the fit.
LENGTHS, BITS, FEATURES = (3, 4, 5, 6), 20, 1 << 14
#: Characters that are hashed at a time; documents of the fit in a block.
STRETCH, BLOCK = 1 << 20, 250


def gram_ids(text: str, active: np.ndarray | None = None) -> np.ndarray:
    """The hashed n-grams of a text, each once; with `active` only those that it marks. White
    space is one space, and there is one before and one after the text."""
    words = " ".join(text.lower().split())
    if not words:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for at in range(0, len(codes), STRETCH):
        part = codes[at : at + STRETCH + LENGTHS[-1] - 1]
        h = part * np.uint32(0x9E3779B1)
        for n in range(2, LENGTHS[-1] + 1):
            if len(part) < n:
                break
            h = h[:-1] * np.uint32(0x85EBCA6B) + part[n - 1 :] * np.uint32(0xC2B2AE35)
            if n in LENGTHS:
                ids = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) + np.uint32(n)) >> np.uint32(32 - BITS)
                found.append(ids if active is None else ids[active[ids]])
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + sum of weights of the present features)))."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        active = np.zeros(1 << BITS, bool)
        active[self.features] = True
        weight = np.zeros(1 << BITS)
        weight[self.features] = self.weights
        margin = np.array([self.bias + weight[gram_ids(t, active)].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def held_out(key: Column) -> Column:
    """Documents whose labels are kept from the fit; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "toxic",
    text: str = "text",
    per_label: int = 3_000,
    penalty: float = 1.0,
    rounds: int = 80,
) -> Model:
    """`per_label`: labelled documents of each class that the fit takes at most."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("id"))
        .agg((F.max(label) > 0).cast("int").alias("y"))
    )
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not totals:
        return Model(np.empty(0, np.int64), np.empty(0), -40.0)
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    constant = Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    if len(totals) < 2:
        return constant
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x per_label ids: a proven bound.
    texts = (
        docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "y")
        .agg(F.min("text").alias("text"))
    )
    sample = written(texts.select("id", "y", "text"), "toxicity-sample")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches):
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y, gram_ids(t)] += 1
        some = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], names=["f", "clean", "toxic"])

    sums = sample.select("y", "text").mapInArrow(count, "f bigint, clean bigint, toxic bigint").groupBy("f").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return constant
    ratio = F.log((F.col("toxic") + 1) / (sizes[1] + 2)) - F.log((F.col("clean") + 1) / (sizes[0] + 2))
    spread = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    ranked = (
        sums.where("clean + toxic >= 3")
        .withColumn("r", ratio)
        .orderBy(F.abs(F.col("r") / spread).desc(), "f")
        .limit(FEATURES)
        .select("f", "r")
    )
    pairs = sorted((row["f"], row["r"]) for row in ranked.collect())
    if not pairs:
        return constant
    features, r = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs])
    place = np.full(1 << BITS, -1, np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)

    def present(batches: Iterator) -> Iterator:
        import pyarrow as pa

        active = place >= 0
        for batch in slices(batches):
            rows = [place[gram_ids(t, active)].tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    schema = T.StructType([sample.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    rows = sorted(sample.mapInArrow(present, schema).collect(), key=lambda row: row["id"])
    y = np.array([row["y"] for row in rows], float)
    x = [np.frombuffer(row["x"], np.int32) for row in rows]
    weights, bias = _logistic(x, y, r, share, penalty, rounds)
    return Model(features, weights * r, bias)


def _logistic(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, share: float, penalty: float, rounds: int, pace: float = 0.05):
    """Weighted logistic regression on x scaled by r, with an L2 penalty on the weights. Steps go
    over all rows at once and adapt to each feature, so that frequent n-grams move as far as rare
    ones. The weights of the classes add up to their true shares."""
    importance = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    # Blocks of documents: the driver holds the features once, in 4 bytes each, and little more.
    blocks = []
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        rows = np.repeat(np.arange(len(part), dtype=np.int32), [len(v) for v in part])
        blocks.append((slice(at, at + len(part)), np.concatenate(part), rows))
    w, bias = np.zeros(len(r)), float(np.log(share / (1 - share)))
    squares, bias_squares = np.full(len(r), 1e-8), 1e-8
    for _ in range(rounds):
        slope, bias_slope, scaled = penalty * w, 0.0, w * r
        for place, flat, rows in blocks:
            n = place.stop - place.start
            margin = bias + np.bincount(rows, scaled[flat], n)
            miss = importance[place] * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[place])
            slope += np.bincount(flat, miss[rows], len(r)) * r
            bias_slope += miss.sum()
        squares += slope * slope
        bias_squares += bias_slope * bias_slope
        w = w - pace * slope / np.sqrt(squares)
        bias -= pace * bias_slope / np.sqrt(bias_squares)
    return w, float(bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of docs, score (0 to 1) and predicted (1 at the threshold or above); columns of
    docs with these names give way to the new ones."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    rows, place = beside_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.scores([t or "" for t in batch.column(place).to_pylist()])
            made = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + made, names=[*kept, "score", "predicted"])

    return rows.mapInArrow(run, schema)
