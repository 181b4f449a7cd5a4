"""Texts as shards of word numbers, each with a vocabulary of its own.

A task cuts its texts into shards of bounded size and numbers the words of a shard as they come.
What is known of a word for the whole corpus (an id, a count, a class) joins the vocabularies, one
row for each word of a shard instead of one for each occurrence, and comes back to the shard's
numbers by `with_words`. No table of all words is ever sent to a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import slices, whole_text, written

#: Tokens of a shard, and bytes of text that are cut into words at a time.
SHARD_TOKENS, STEP = 1 << 21, 1 << 20
#: The token that ends every text, and stands between parts of it: words hold no line break.
END = b"\n"
#: Its number in every shard; 0 stands for nothing.
END_NUMBER = 1


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, of which small ones are frequent: their bytes plane by plane,
    compressed. What is moved and stored is a fraction of 4 bytes for each."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i4")


def letters(blanks: bytes, breaks: bytes = b"") -> bytes:
    """For bytes.translate: A-Z in lower case, blanks that part words, breaks that part pieces."""
    return bytes.maketrans(
        bytes(range(65, 91)) + blanks + breaks, bytes(range(97, 123)) + b" " * len(blanks) + END * len(breaks)
    )


class Shard:
    """Texts as the numbers of their words; every text ends with END."""

    def __init__(self, table: bytes) -> None:
        self.table = table
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b""], self.numbers[END]
        self.keys, self.counted, self.waiting, self.bytes = [], [], [], 0
        self.parts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, text: bytes, key, counted: bool) -> None:
        self.keys.append(key)
        self.counted.append(counted)
        self.waiting.append(text.translate(self.table))
        self.bytes += len(text) + 1
        if self.bytes >= STEP:
            self.take()

    def take(self) -> None:
        """Number the words of the waiting texts."""
        data = b"".join(t + END for t in self.waiting)
        self.waiting, self.bytes = [], 0
        at = 0
        while at < len(data):
            cut = data.find(b" ", at + STEP)
            cut = len(data) if cut < 0 else cut
            words = data[at:cut].replace(END, b" \n ").split(b" ")
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self.parts.append(found[found > 0])
            self.tokens += len(self.parts[-1])
            at = cut

    def row(self, shard: int, group: str | None, kind: pa.DataType) -> list[pa.Array]:
        self.take()
        numbers = np.concatenate(self.parts)
        words = list(self.numbers)[END_NUMBER:]
        # Only tokens of counted texts count; a text goes up to its last END.
        if all(self.counted):
            counts = np.bincount(numbers, minlength=len(words) + 1)[END_NUMBER:]
        else:
            lengths = np.diff(np.flatnonzero(numbers == END_NUMBER), prepend=-1)
            some = numbers[np.repeat(np.array(self.counted, bool), lengths)]
            counts = np.bincount(some, minlength=len(words) + 1)[END_NUMBER:]

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return [
            pa.array([shard], pa.int64()),
            pa.array([group], pa.string()),
            one(pa.array(self.keys, kind)),
            one(pa.array(self.counted, pa.bool_())),
            one(pa.array(words, pa.binary())),
            one(pa.array(counts, pa.int64())),
            pa.array([packed(numbers)], pa.binary()),
        ]


def word_shards(
    docs: DataFrame, table: bytes, text: str = "text", group: Column | None = None, key: Column | None = None, counted: Column | None = None
) -> DataFrame:
    """A written table with one row for each shard: shard (its number), grp, keys and counted (of
    its texts in order), words, counts (occurrences in counted texts), numbers (`packed` numbers
    of the tokens: 1 + the word's place in words, END is the first word).

    A shard holds texts of one group. `counted` must be plain where several texts end in pieces:
    it is only looked at text by text if `table` has no breaks. Null texts count as empty."""
    rows = docs.select(
        (group if group is not None else F.lit(None)).cast("string").alias("grp"),
        (key if key is not None else F.lit(None).cast("bigint")).alias("key"),
        (counted if counted is not None else F.lit(True)).alias("counted"),
        whole_text(text).cast("binary").alias("text"),
    )
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        names = ["shard", "grp", "keys", "counted", "words", "counts", "numbers"]
        open_shards: dict[str | None, Shard] = {}
        for batch in slices(batches):
            key_type = batch.column(1).type
            for g, k, c, t in zip(*(column.to_pylist() for column in batch.columns)):
                shard = open_shards.get(g)
                if shard is None:
                    shard = open_shards[g] = Shard(table)
                shard.add(t, k, c)
                if shard.tokens >= SHARD_TOKENS:
                    yield pa.RecordBatch.from_arrays(open_shards.pop(g).row(next(numbers), g, key_type), names=names)
            # Many groups: no task holds more than a few shards at a time.
            if sum(s.tokens for s in open_shards.values()) >= 4 * SHARD_TOKENS or len(open_shards) > 64:
                for g in list(open_shards):
                    yield pa.RecordBatch.from_arrays(open_shards.pop(g).row(next(numbers), g, key_type), names=names)
        for g, shard in open_shards.items():
            yield pa.RecordBatch.from_arrays(shard.row(next(numbers), g, key_type), names=names)

    schema = f"shard bigint, grp string, keys array<{kind}>, counted array<boolean>, words array<binary>, counts array<bigint>, numbers binary"
    return written(rows.mapInArrow(run, schema), "word-shards")


def word_counts(shards: DataFrame) -> DataFrame:
    """(grp, word, n): occurrences in counted texts; END is a word."""
    return (
        shards.select("grp", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        .groupBy("grp", F.col("w.words").alias("word"))
        .agg(F.sum("w.counts").alias("n"))
    )


def with_words(
    shards: DataFrame,
    columns: list[str],
    known: DataFrame,
    run: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    unless: str = "false",
) -> DataFrame:
    """run(shard's row with `columns`, rows of `known` for its words) for every shard. `known` has
    grp, word and more columns; they come with `number`, that of the word in the shard. Rows stay
    out for which `unless` holds, SQL over them and `local`, the word's count in the shard."""
    words = shards.select(
        F.col("shard").alias("of"), F.col("grp").alias("_grp"), F.posexplode(F.arrays_zip("words", "counts")).alias("_at", "_w")
    ).select("of", "_grp", "_at", F.col("_w.words").alias("_word"), F.col("_w.counts").alias("local"))
    same = F.col("_grp").eqNullSafe(F.col("grp")) & (F.col("_word") == F.col("word"))
    marks = words.join(known, same).where(f"NOT ({unless})").select(
        "of", (F.col("_at") + END_NUMBER).alias("number"), *[c for c in known.columns if c not in ("grp", "word")]
    )
    return shards.select("shard", *columns).groupBy("shard").cogroup(marks.groupBy("of")).applyInArrow(run, schema)
