"""Phrase collocations from counting quotient filters.

Words that are frequent enough to be in a phrase get ids in their language. Every shard of texts
counts its n-grams of such words in quotient filters, one for each range of permuted keys; the
filters of a range are merged across shards, and what occurs often enough is a candidate. Copies of
a phrase meet as one counter of each shard, so a frequent one is no load. Scores are exact whole
numbers: parts of a candidate are candidates or frequent words themselves, so all counts are there.

A language that is null is `und`; null texts count as empty; pieces never cross texts; rows that
repeat count again. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm import quotient as qf
from runsift.llm import word_shards as ws
from runsift.llm.common import HOT, buckets_for, joined_by_parts, numbered, written

#: Entries that are merged at a time, and ranges at most.
RANGE_ENTRIES, MOST_RANGE_BITS = 1 << 21, 20
#: N-grams of a shard whose keys are made at a time, and bits for the parts that are sorted at a time.
STEP, PART_BITS = 1 << 18, 4
#: Bytes of filters, about, that go back to Spark at a time.
BATCH_BYTES = 1 << 21
#: Parts in which candidates of a language are ranked before the best of all parts are.
PARTS = 8

PIECES = ws.letters(b"\t", b".,;:!?\n\x0b\x0c\r")


def shard_filters(w: np.ndarray, u: int, skip: int) -> Iterator[tuple[int, qf.QuotientFilter]]:
    """The filters of the phrases of a shard, range by range. w: ids of its tokens in order, 0 where
    there is none. Only one pair of halves is held for each n-gram, all else for a part of them."""
    half = 3 * u
    w = np.r_[w, np.zeros(2, w.dtype)]
    two = (w[:-2] > 0) & (w[1:-1] > 0)
    size = int(np.count_nonzero(two)) + int(np.count_nonzero(two & (w[2:] > 0)))
    left, right, at = np.empty(size, np.uint64), np.empty(size, np.uint64), 0
    for s in range(0, len(two), STEP):
        for n in (2, 3):
            first = s + np.flatnonzero(two[s : s + STEP])
            first = first[w[first + 2] > 0] if n == 3 else first
            third = w[first + 2] if n == 3 else np.zeros(len(first), w.dtype)
            to = slice(at, at := at + len(first))
            left[to], right[to] = qf.permute(*qf.pack(w[first], w[first + 1], third, u), half)
    # A part is made of whole ranges, and parts come in the order of ranges.
    bits = min(skip, PART_BITS)
    part = (left >> np.uint64(half - bits)).astype(np.uint8)
    for p in range(1 << bits):
        mine = np.flatnonzero(part == p)
        l, r, n = qf.summed(left[mine], right[mine], np.ones(len(mine), np.int64))
        of = l >> np.uint64(half - skip)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
            yield int(of[s]), qf.QuotientFilter.build(l[s:e], r[s:e], n[s:e], half, skip)


def ngram_counts(shards: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """(grp, w1, w2, w3, n): phrases of two (w3 is 0) and three ids that occur `least` times.
    vocabulary: grp, word, n, id (from 1); a token without an id is in no phrase."""
    facts = vocabulary.agg(F.coalesce(F.max("id"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    u, tokens = qf.half_bits(facts[0]), int(facts[1])
    half = 3 * u
    skip = min(max(0, (2 * tokens // RANGE_ENTRIES).bit_length()), MOST_RANGE_BITS, half)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        grp = left.column("grp")[0].as_py()
        numbers = ws.unpacked(left.column("numbers")[0].as_py())
        ids = np.zeros(int(numbers.max(initial=0)) + 1, np.uint32)
        ids[right.column("number").to_numpy()] = right.column("id").to_numpy()
        w = ids[numbers]
        del numbers
        batches, waiting, size = [], [], 0
        for range_, f in shard_filters(w, u, skip):
            waiting.append((grp, range_, f.q, f.n, f.occupied, f.runends, f.remainders, f.counters))
            size += len(f.remainders)
            # Batches stay small, because the JVM holds each in one buffer outside its heap.
            if size >= BATCH_BYTES:
                batches.append(pa.RecordBatch.from_pylist([dict(zip(kinds.names, row)) for row in waiting], kinds))
                waiting, size = [], 0
        batches.append(pa.RecordBatch.from_pylist([dict(zip(kinds.names, row)) for row in waiting], kinds))
        return pa.Table.from_batches(batches)

    def merge(table: pa.Table) -> pa.Table:
        range_ = table.column("range")[0].as_py()
        filters = [qf.QuotientFilter(half, skip, *parts) for parts in zip(*(table.column(c).to_pylist() for c in table.column_names[2:]))]
        l, r, n = qf.merged(filters, range_)
        often = n >= least
        w1, w2, w3 = qf.unpack(*qf.unpermute(l[often], r[often], half), u)
        grp = pa.array([table.column("grp")[0].as_py()] * len(w1), pa.string())
        return pa.table({"grp": grp, "w1": w1, "w2": w2, "w3": w3, "n": n[often]})

    schema = "grp string, range bigint, q int, n int, occupied binary, runends binary, remainders binary, counters binary"
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    kinds = pa.schema([(part.split()[0], kind) for part, kind in zip(schema.split(", "), types)])
    filters = ws.with_words(shards, ["grp", "numbers"], vocabulary.select("grp", "word", "id"), count, schema)
    return filters.groupBy("grp", "range").applyInArrow(merge, "grp string, w1 bigint, w2 bigint, w3 bigint, n bigint")


def looked_up(rows: DataFrame, table: DataFrame, on: dict[str, str], values: dict[str, str], hot: Column) -> DataFrame:
    """rows with values of the table's row of the same key (`on`: column of rows to column of the
    table; each key stands once in the table). Written, because it reads its rows twice: plans of
    several look-ups would double with each."""
    side = table.select(*[F.col(t).alias(r) for r, t in on.items()], *[F.col(t).alias(v) for v, t in values.items()], hot.alias("_hot"))
    return written(joined_by_parts(rows, side, list(on), F.col("_hot")).drop("_hot"), "phrase-looked-up")


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), exact while counts are below 10^15."""
    d = [x.cast("decimal(15,0)") for x in (a, l, r)]
    return F.call_function("div", d[0] * d[0] * F.lit(1_000_000).cast("decimal(7,0)"), d[1] * d[2])


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, inside_percent: int = 50
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score, words: the `top` phrases of each language.

    a: occurrences of the phrase; l, r: of its parts at the cut with the lowest score (the first on
    ties); n: of all words of the language. A phrase inside a longer candidate that occurs at least
    `inside_percent` of a hundred times as often is left out."""
    shards = ws.word_shards(docs, PIECES, text, group=F.coalesce(F.col(lang).cast("string"), F.lit("und")))
    counts = written(ws.word_counts(shards).where(F.col("word") != F.lit(ws.END)), "phrase-words")
    sizes = counts.groupBy("grp").agg(F.sum("n").alias("all"))
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    frequent = written(counts.where(F.col("n") >= least), "phrase-frequent")
    words = numbered(frequent, ["grp"], ["word"], buckets_for(frequent.count(), 100_000), "id")
    words = written(words.withColumn("id", F.col("id") + 1), "phrase-vocabulary")
    found = written(ngram_counts(shards, words, least), "phrase-candidates")
    two, three = found.where("w3 = 0"), found.where("w3 > 0")
    hot = F.col("n") * HOT >= total

    def word(rows: DataFrame, place: str, count: str) -> DataFrame:
        return looked_up(rows, words, {"grp": "grp", place: "id"}, {count: "n", f"{place}_text": "word"}, hot)

    def pair(rows: DataFrame, first: str, second: str, count: str) -> DataFrame:
        return looked_up(rows, two, {"grp": "grp", first: "w1", second: "w2"}, {count: "n"}, hot)

    longer = (
        three.select("grp", "w1", "w2", "n")
        .unionByName(three.select("grp", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
        .groupBy("grp", "w1", "w2")
        .agg(F.max("n").alias("most"))
    )
    pairs = (
        two.join(longer, ["grp", "w1", "w2"], "left")
        .where(F.coalesce(100 * F.col("most"), F.lit(0)) < inside_percent * F.col("n"))
        .drop("most")
    )
    pairs = word(word(pairs, "w1", "l"), "w2", "r").select(
        "grp", F.concat_ws(" ", *[F.col(f"w{k}_text").cast("string") for k in (1, 2)]).alias("phrase"),
        F.col("n").alias("a"), "l", "r", score(F.col("n"), F.col("l"), F.col("r")).alias("score"), F.lit(2).alias("words"),
    )
    parts = word(word(word(pair(pair(three, "w1", "w2", "n12"), "w2", "w3", "n23"), "w1", "n1"), "w2", "n2"), "w3", "n3")

    def cut(left: str, right: str) -> Column:
        return F.struct(score(F.col("n"), F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    cuts = parts.withColumn("_one", cut("n1", "n23")).withColumn("_two", cut("n12", "n3"))
    best = F.when(F.col("_one.score") <= F.col("_two.score"), F.col("_one")).otherwise(F.col("_two"))
    triples = cuts.withColumn("_cut", best).select(
        "grp", F.concat_ws(" ", *[F.col(f"w{k}_text").cast("string") for k in (1, 2, 3)]).alias("phrase"),
        F.col("n").alias("a"), "_cut.l", "_cut.r", "_cut.score", F.lit(3).alias("words"),
    )
    # The last ranking sees at most PARTS x top rows of a language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    every = pairs.unionByName(triples).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["grp", "_part"], ["grp"]):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return every.join(sizes.withColumnRenamed("grp", "_grp"), F.col("grp") == F.col("_grp")).select(
        F.col("grp").alias("lang"), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score", "words"
    )
