"""Language model on Brown classes: exchange clustering, class transitions, word emissions.

Every word has one class. P(word | before) = P(class of word | class of the word before) times
P(word | its class). Classes come from exchange clustering: in each round half of the words move,
each to the class that raises the likelihood of the class bigrams most, all in parallel against
the counts of the round before; a round that lowers the likelihood is not taken.

Words that occur at least 5 times in training are exchanged, whatever the size of the input. All
other words have a class by the power of two of their count; the token that ends a text has its own.
All counts cover all training texts and all words. Classes of up to 2^22 words are a vector that
every task gets; those of more words are a table, and every shard gets those of its own words by a
join. Both ways have the same results.

Smoothing: transitions are mixed with the share of the class, as if it had been seen CLASSES more
times. An unknown word is one event (as in the add-one base), of a probability that depends on the
class before: how often a word that occurs once in training follows it. As the word before, it
counts as a word that occurs once.

Null texts count as empty and hold the end only. Rows with a null key are not held out. Repeated
rows are rows of their own. Without training texts nothing is known: base_score and score are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm import word_shards as ws
from runsift.llm.common import buckets_for, numbered, written

#: Classes of exchanged words, and of the others by the power of two of their count.
CLASSES, BANDS = 64, 24
#: All classes; the last is that of the end. Unknown words are numbered behind it.
ALL = CLASSES + BANDS + 1
LEAST, ROUNDS = 5, 4
#: Words whose classes are one vector; those of more words are a table.
SENT_WORDS = 1 << 22
#: Tokens whose neighbours a task adds up before they move; neighbours that are weighed at a time.
GATHERED, WEIGHED = 1 << 21, 1 << 13
#: Largest count in two bytes.
MOST = 65_535

WORDS = ws.letters(b"\t\n\x0b\x0c\r ")


def held_out(key: Column) -> Column:
    """Texts that the model does not learn from; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """What the class bigrams `pairs` (before, after) contribute to the log likelihood."""
    return float(x_log_x(pairs).sum() - x_log_x(pairs.sum(0)).sum() - x_log_x(pairs.sum(1)).sum())


def better_classes(pairs: np.ndarray, own: np.ndarray, word: np.ndarray, near: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each word 0, 1, ... given its neighbours. Neighbour k of `word[k]` (in
    order) is of class near[k], before it if near[k] < ALL, behind it (class near[k] - ALL) else,
    n[k] times. `own`: classes now."""
    # Columns: all neighbours; rows: the classes to choose from.
    table = np.concatenate([pairs[:, :CLASSES].T, pairs[:CLASSES, :]], axis=1).astype(float)
    gain = np.zeros((len(own), CLASSES))
    for at in range(0, len(word), WEIGHED):
        part = slice(at, at + WEIGHED)
        there = table[:, near[part]].T
        times = n[part][:, None].astype(float)
        mine = own[word[part]]
        rows = np.arange(len(mine))
        # A word's own class holds it already: take it out before it is put in.
        there[rows, mine] = np.maximum(there[rows, mine] - times[:, 0], 0)
        change = x_log_x(there + times) - x_log_x(there)
        starts = np.flatnonzero(np.r_[True, np.diff(word[part]) != 0])
        gain[word[part][starts]] += np.add.reduceat(change, starts)
    for side, totals in ((near < ALL, pairs.sum(0)), (near >= ALL, pairs.sum(1))):
        size = np.bincount(word[side], n[side], len(own))[:, None]
        whole = np.repeat(totals[None, :CLASSES].astype(float), len(own), axis=0)
        rows = np.arange(len(own))
        whole[rows, own] = np.maximum(whole[rows, own] - size[:, 0], 0)
        gain -= x_log_x(whole + size) - x_log_x(whole)
    best = gain.argmax(axis=1)
    # Stay where nothing is won.
    rows = np.arange(len(own))
    return np.where(gain[rows, best] > gain[rows, own] + 1e-9, best, own)


class BrownModel:
    """classes: of every code, a vector or a table (code, class); a code is an exchanged word's id or
    stands for a class by count, for the end, or for an unknown word (the last). pairs: class bigrams
    of the training texts."""

    def __init__(self, classes: np.ndarray | DataFrame, pairs: np.ndarray) -> None:
        self.classes, self.pairs = classes, pairs

    def steps(self) -> np.ndarray:
        """log10 of a step from class to class, without the count of the word; the last row and
        column are unknown words."""
        pairs = self.pairs.astype(float)
        before, after, total = pairs.sum(1), pairs.sum(0), pairs.sum()
        out = np.zeros((ALL + 1, ALL + 1))
        if not total:
            return out
        share = after / total
        seen_once = CLASSES  # the class of words that occur once
        novel = (pairs[:, seen_once] + ALL * (after[seen_once] + 0.5) / (total + 1)) / (before + ALL)
        move = (pairs + ALL * share) / (before + ALL)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log10(1 - novel)[:, None] + np.log10(move) - np.log10(after)[None, :]
        out[:ALL, :ALL] = np.where(after[None, :] > 0, known, 0)
        out[:ALL, ALL] = np.log10(novel)
        out[ALL] = out[seen_once]
        return out


def _coded(shards: DataFrame, codes: DataFrame, words: int, tokens: int, types: int) -> DataFrame:
    """The shards with codes instead of words, and sums of every text. `ids`: the steps between the
    sorted codes of the shard; `codes`: places among them, token by token. Of a word that occurs once,
    in this shard, the shard knows all; such words need no row."""
    once, end, unknown = words, words + BANDS, words + BANDS + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = left.slice(0, 1)
        numbers = ws.unpacked(shard.column("numbers")[0].as_py())
        place = right.column("number").to_numpy()
        size = int(numbers.max(initial=0)) + 1
        n = np.zeros(size, np.int64)
        n[ws.END_NUMBER :] = shard.column("counts")[0].values.to_numpy()[: size - ws.END_NUMBER]
        code = np.where(n > 0, once, unknown).astype(np.int32)
        code[ws.END_NUMBER : ws.END_NUMBER + 1] = end
        n[place], code[place] = right.column("n").to_numpy(), right.column("code").to_numpy()
        ids, local = np.unique(code, return_inverse=True)
        base, own = np.log10((n + 1) / (tokens + types + 1)), np.log10(np.maximum(n, 1))
        ends = np.flatnonzero(numbers == ws.END_NUMBER)
        starts = np.r_[0, ends[:-1] + 1]

        def per_text(values: np.ndarray) -> pa.Array:
            sums = np.add.reduceat(values[numbers], starts)
            return pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), pa.array(sums))

        return pa.table(
            {
                "shard": shard.column("shard"),
                "keys": shard.column("keys"),
                "counted": shard.column("counted"),
                "n_tokens": per_text(np.ones(size, np.int64)),
                "n_known": per_text((n > 0).astype(np.int64)),
                "base": per_text(base),
                "own": per_text(own),
                "ids": pa.array([ws.packed(np.diff(ids, prepend=0))], pa.binary()),
                "codes": pa.array([ws.packed(local[numbers])], pa.binary()),
            }
        )

    kind = dict(shards.dtypes)["keys"]
    schema = (
        f"shard bigint, keys {kind}, counted array<boolean>, n_tokens array<bigint>, n_known array<bigint>, "
        "base array<double>, own array<double>, ids binary, codes binary"
    )
    return written(ws.with_words(shards, ["keys", "counted", "counts", "numbers"], codes, run, schema, "n = 1 AND local = 1"), "brown-coded")


def _ids(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.cumsum(ws.unpacked(batch.column("ids")[at].as_py()), dtype=np.int32)


#: The classes of the ids of a shard, given a batch and its place there.
Look = Callable[[pa.RecordBatch, int], np.ndarray]


def _classed(coded: DataFrame, classes: np.ndarray | DataFrame) -> tuple[DataFrame, Look]:
    """coded, and how its tasks find the classes of a shard's ids."""
    if isinstance(classes, np.ndarray):
        sent = coded.sparkSession.sparkContext.broadcast(classes)
        return coded, lambda batch, at: sent.value[_ids(batch, at)]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, shard in enumerate(batch.column("shard").to_pylist()):
                ids = _ids(batch, at)
                columns = [np.full(len(ids), shard), np.arange(len(ids), dtype=np.int32), ids]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["of", "at", "code"])

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(right.num_rows, np.uint8)
        found[right.column("at").to_numpy()] = right.column("class").to_numpy()
        return left.append_column("classes", pa.array([found.tobytes()], pa.binary()))

    marks = coded.select("shard", "ids").mapInArrow(places, "of bigint, at int, code int").join(classes, "code").select("of", "at", "class")
    schema = ", ".join(f"{name} {kind}" for name, kind in [*coded.dtypes, ("classes", "binary")])
    both = coded.groupBy("shard").cogroup(marks.groupBy("of")).applyInArrow(attach, schema)
    return both, lambda batch, at: np.frombuffer(batch.column("classes")[at].as_py(), np.uint8)


def _training(batch: pa.RecordBatch, look: Look, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of the training texts of a shard and their classes, one END before them."""
    for at in range(batch.num_rows):
        ids = _ids(batch, at)
        found, stop = ws.unpacked(batch.column("codes")[at].as_py()), np.searchsorted(ids, end)
        lengths = np.diff(np.flatnonzero(found == stop), prepend=-1)
        found = np.r_[np.int32(stop), found[np.repeat(np.array(batch.column("counted")[at].as_py(), bool), lengths)]]
        yield ids[found], look(batch, at)[found]


def class_pairs(coded: DataFrame, classes: np.ndarray | DataFrame, words: int) -> np.ndarray:
    """Class bigrams (before, after) of the training texts: ALL x ALL numbers reach the driver."""
    end = words + BANDS
    classed, look = _classed(coded.select("shard", "ids", "codes", "counted"), classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            for _, c in _training(batch, look, end):
                c = c.astype(np.int16)
                found += np.bincount(c[:-1] * np.int16(ALL) + c[1:], minlength=ALL * ALL)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["at", "n"])

    pairs = np.zeros(ALL * ALL, np.int64)
    for row in classed.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        pairs[row["at"]] = row["n"]
    return pairs.reshape(ALL, ALL)


def _pieces(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value for each run of values that begins at a start."""
    ends = (np.r_[starts, len(values)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _joined(pieces: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary pieces one after the other, and how many each has."""
    kind = np.dtype(kind)
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    return np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // kind.itemsize


def exchange(coded: DataFrame, classes: np.ndarray | DataFrame, pairs: np.ndarray, turn: int, words: int) -> np.ndarray | DataFrame:
    """The classes after a round that moves the words whose id is odd or even, as turn is."""
    end = words + BANDS
    # 2 x ALL classes beside a word take 8 bits, 2^22 words 22 more.
    width = np.int32 if words <= 1 << 22 else np.int64
    classed, look = _classed(coded.select("shard", "ids", "codes", "counted"), classes)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each moving word the classes beside it: one row for some millions of tokens."""

        def rows(keys: list[np.ndarray]) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            # Two bytes for a count: a larger one is several.
            times = -(-n // MOST)
            last = n - MOST * (times - 1)
            n = np.full(int(times.sum()), MOST, "<u2")
            n[np.cumsum(times) - 1] = last
            key = np.repeat(key, times)
            word = (key >> 8).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, np.diff(word) != 0])
            return pa.RecordBatch.from_arrays(
                [pa.array(word[starts]), _pieces((key & 255).astype(np.uint8), starts), _pieces(n, starts)], names=["word", "near", "n"]
            )

        held, size = [], 0
        for batch in batches:
            for codes, c in _training(batch, look, end):
                moves = (codes < words) & (codes % 2 == turn % 2)
                behind, before = moves[1:], moves[:-1]
                held.append(codes[1:][behind].astype(width) << 8 | c[:-1][behind])
                held.append(codes[:-1][before].astype(width) << 8 | c[1:][before] + np.uint8(ALL))
                size += len(held[-2]) + len(held[-1])
                if size >= GATHERED:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of words; those of the last word of a batch may go on."""

        def moved(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, n)
            ids, word = np.unique(key >> 8, return_inverse=True)
            best = better_classes(pairs, ids & 255, word, key & 255, n)
            return pa.RecordBatch.from_arrays(
                [pa.array([(ids >> 8).astype("<i4").tobytes()]), pa.array([best.astype(np.uint8).tobytes()])], names=["words", "classes"]
            )

        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            near, lengths = _joined(batch.column(1), np.uint8)
            n, _ = _joined(batch.column(2), np.dtype("<u2"))
            ids = batch.column(0).to_numpy()
            mine = sent.value[ids] if sent else batch.column(3).to_numpy()
            # A word, its class, and a class beside it.
            key = np.repeat(ids << 8 | mine.astype(np.int64), lengths) << 8 | near.astype(np.int64)
            # What is held is of one word: at most 2 x ALL sums.
            keys, counts = np.r_[keys, key], np.r_[counts, n.astype(np.int64)]
            last = keys >> 8 == key[-1] >> 8
            if not last.all():
                yield moved(keys[~last], counts[~last])
            keys, at = np.unique(keys[last], return_inverse=True)
            counts = np.bincount(at, counts[last]).astype(np.int64)
        if len(keys):
            yield moved(keys, counts)

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i4")), pa.array(np.frombuffer(found, "i1"))], names=["code", "class"])

    beside = classed.mapInArrow(neighbours, "word bigint, near binary, n binary")
    sent = None
    if isinstance(classes, np.ndarray):
        sent = coded.sparkSession.sparkContext.broadcast(classes)
    else:
        beside = beside.join(classes.withColumnRenamed("code", "word"), "word").select("word", "near", "n", "class")
    chosen = beside.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "words binary, classes binary")
    if not sent:
        # Every word that moves has neighbours: it occurs in training.
        others = classes.where((F.col("code") >= words) | (F.col("code") % 2 != turn % 2))
        return written(others.unionByName(chosen.mapInArrow(by_word, "code int, class tinyint")), "brown-classes")
    after = classes.copy()
    for row in chosen.collect():
        after[np.frombuffer(row["words"], "<i4")] = np.frombuffer(row["classes"], np.uint8)
    return after


def first_classes(docs: DataFrame, words: int) -> np.ndarray | DataFrame:
    """Classes of all codes before the first round; a vector has at most SENT_WORDS + 26 bytes."""
    if words <= SENT_WORDS:
        return np.r_[np.arange(words) % CLASSES, np.arange(CLASSES, ALL), ALL].astype(np.uint8)
    code = F.col("id").cast("int")
    start = F.when(code < words, code % CLASSES).otherwise(code - words + CLASSES)
    rows = docs.sparkSession.range(words + BANDS + 2).select(code.alias("code"), start.cast("tinyint").alias("class"))
    return written(rows, "brown-classes")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of
    the whole text), perplexity (of the model, by token), one row for each row of docs."""
    shards = ws.word_shards(docs, WORDS, text, key=F.col(key), counted=~held_out(F.col(key)))
    counts = written(ws.word_counts(shards).where("n > 0"), "brown-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = int(total[0]), int(total[1])
    is_end = F.col("word") == F.lit(ws.END)
    frequent = written(counts.where((F.col("n") >= LEAST) & ~is_end), "brown-frequent")
    words = frequent.count()
    moving = numbered(frequent, [], ["word"], buckets_for(words, 100_000), "code")
    rest = counts.where((F.col("n") < LEAST) | is_end).withColumn(
        "code", F.when(is_end, words + BANDS).otherwise(words + F.least(F.floor(F.log2("n") + 1e-9), F.lit(BANDS - 1)))
    )
    columns = ["grp", "word", "n", F.col("code").cast("int").alias("code")]
    codes = written(moving.select(*columns).unionByName(rest.select(*columns)), "brown-codes")
    coded = _coded(shards, codes, words, tokens, types)

    classes = first_classes(docs, words)
    model = BrownModel(classes, class_pairs(coded, classes, words))
    for turn in range(rounds if words else 0):
        after = exchange(coded, model.classes, model.pairs, turn, words)
        pairs = class_pairs(coded, after, words)
        if likelihood(pairs) > likelihood(model.pairs):
            model = BrownModel(after, pairs)

    classed, look = _classed(coded, model.classes)
    steps, end = model.steps(), words + BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                codes = ws.unpacked(row.column("codes")[0].as_py())
                c = look(batch, at)[codes].astype(np.int64)
                log = steps[np.r_[ALL - 1, c[:-1]], c]
                starts = np.r_[0, np.flatnonzero(codes == np.searchsorted(_ids(batch, at), end))[:-1] + 1]
                n_tokens = row.column("n_tokens").flatten()
                scores = np.add.reduceat(log, starts) + row.column("own").flatten().to_numpy()
                scores = np.minimum(scores, 0.0)
                per_token = 10 ** np.minimum(-scores / n_tokens.to_numpy(), 300)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column("keys").flatten(), pa.array(~np.array(row.column("counted").flatten().to_pylist(), bool)),
                        n_tokens, row.column("n_known").flatten(), pa.array(np.full(len(starts), tokens)),
                        row.column("base").flatten(), pa.array(scores), pa.array(per_token),
                    ],
                    names=names,
                )

    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kind = dict(docs.select(F.col(key)).dtypes)[key]
    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return classed.mapInArrow(run, schema).withColumnRenamed("key", key)
