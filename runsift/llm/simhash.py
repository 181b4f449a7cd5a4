"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 of 64 bits: cut the bits into three blocks; some two of
the blocks together hold at most 2 of the differences. Every distinct fingerprint emits, for each
pair of blocks, all values of their 42 or 43 bits within half that radius, 1: 44 keys or less, 131
in all. Linked fingerprints meet at a key. The keys are shuffled, and within a key the collisions
are checked on all 64 bits, each class of linked fingerprints once.

(Balls of radius 1 over all 64 bits would miss pairs at distance 3, and of radius 2 would be 2,081
keys for each fingerprint; the blocks make half the radius a whole number.)

A key may be met by very many fingerprints. Their members are not compared in pairs beyond PAIRED:
then the same exact question is asked by looking up the values of the other bits near each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import free_name, has_plain_key, sent, slices, whole_text, written
from runsift.llm.components import components

#: First bit and width of the three blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Members of a key that are compared in pairs.
PAIRED = 2048
#: Shingles that are hashed at a time.
STRETCH = 1 << 15


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Bit is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats
    included. Words are split at ASCII white space; A-Z are lower-cased. A text with fewer words is
    one shingle; one without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(words_per_shingle, len(words)) - 1
    starts, ends = starts[: len(words) - span].tolist(), ends[span:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), STRETCH):
        part = zip(starts[at : at + STRETCH], ends[at : at + STRETCH])
        hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the 64 bits as a signed long. Null texts count as empty."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    return (
        docs.select(F.col(key), whole_text(text).alias("text"))
        .mapInArrow(run, f"key {kind}, fp bigint")
        .withColumnRenamed("key", key)
    )


def _masks() -> list[tuple[int, list[int]]]:
    """For each pair of blocks: the mask of their bits, and those bits one by one."""
    out = []
    for left_out in range(3):
        bits = [first + k for n, (first, width) in enumerate(BLOCKS) if n != left_out for k in range(width)]
        out.append((sum(1 << b for b in bits), bits))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def variants(prints: DataFrame) -> DataFrame:
    """(pair, key, fp): every fingerprint at all values within half the radius, by pair of blocks."""
    balls = []
    for pair, (mask, bits) in enumerate(_masks()):
        flips = ",".join(["0L", *[f"{_signed(1 << b)}L" if b < 63 else "shiftleft(1L, 63)" for b in bits]])
        balls.append(f"transform(array({flips}), x -> struct({pair} AS pair, (fp & {_signed(mask)}L) ^ x AS key))")
    return prints.select("fp", F.explode(F.expr(f"concat({','.join(balls)})")).alias("k")).select("k.pair", "k.key", "fp")


def linked(prints: np.ndarray, mask: int, near: int = 3) -> np.ndarray:
    """The class (its smallest member as unsigned number) of each fingerprint that met at a key of
    the blocks in `mask`: classes of those that differ in at most `near` bits, directly or over
    others here. All members are within one bit of the key in the bits of the mask."""
    n = len(prints)
    parent = np.arange(n)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        """Merge the classes of a[k] and b[k], by passing down the smaller label until nothing
        changes."""
        nonlocal parent
        while True:
            low = np.minimum(parent[a], parent[b])
            before = parent.copy()
            np.minimum.at(parent, parent[a], low)
            np.minimum.at(parent, parent[b], low)
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            if np.array_equal(before, parent):
                return

    if n <= PAIRED:
        i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= near, 1))
        union(i, j)
    else:
        # Equal other bits: at most 2 apart. One apart there: at most 3 apart. Two apart there: the
        # masked bits may differ in one. Three apart: they must be equal.
        inside, rest = prints & np.uint64(mask), prints & np.uint64(mask ^ ((1 << 64) - 1))
        bits = [b for b in range(64) if not mask >> b & 1]
        order = np.argsort(rest, kind="stable")
        sorted_rest = rest[order]
        first = order[np.searchsorted(sorted_rest, rest)]
        union(np.arange(n), first)
        for b in bits:
            look = rest ^ np.uint64(1 << b)
            at = np.minimum(np.searchsorted(sorted_rest, look), n - 1)
            hit = np.flatnonzero(sorted_rest[at] == look)
            union(hit, order[at[hit]])
        whole = np.sort(prints)
        place = np.argsort(prints, kind="stable")
        values, counts = np.unique(inside, return_counts=True)
        inner_flips = [b for b in range(64) if mask >> b & 1]
        # The members all lie within one bit of the key, so few values of the masked bits occur.
        for x, b in enumerate(bits):
            for y in range(x):
                two = np.uint64(1 << b | 1 << bits[y])
                deltas = [two, *[two ^ (values[k] ^ values[m]) for k in range(len(values)) for m in range(k) if int(values[k] ^ values[m]).bit_count() == 1]]
                deltas += [two | np.uint64(1 << bits[z]) for z in range(y)]
                for delta in set(map(int, deltas)):
                    look = prints ^ np.uint64(delta)
                    at = np.minimum(np.searchsorted(whole, look), n - 1)
                    hit = np.flatnonzero(whole[at] == look)
                    if len(hit):
                        union(hit, place[at[hit]])
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, parent, prints)
    return least[parent]


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp`, a star for each class found at a key; two
    fingerprints are in one component of these edges if and only if they are in one of the links."""
    import pyarrow as pa

    masks = [mask for mask, _ in _masks()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(pair: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            ends = np.r_[np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1, len(key)]
            starts = np.r_[0, ends[:-1]]
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            many = ends - starts > 1
            two = many & (ends - starts == 2)
            # Most keys with company have two members.
            s = starts[two]
            close = np.bitwise_count(fp[s] ^ fp[s + 1]) <= 3
            a.append(fp[s][close])
            b.append(fp[s + 1][close])
            for s, e in zip(starts[many & ~two].tolist(), ends[many & ~two].tolist()):
                roots = linked(fp[s:e], masks[pair[s]])
                other = roots != fp[s:e]
                a.append(fp[s:e][other])
                b.append(roots[other])
            edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []  # rows of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((columns[0], columns[1], columns[2].view(np.uint64)))
            if columns[0][0] == columns[0][-1] == held[0][0][0] and columns[1][0] == columns[1][-1] == held[0][1][0]:
                continue  # all of one key so far
            pair, key, fp = (np.concatenate(c) for c in zip(*held))
            cut = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))[-1] + 1
            yield stars(pair[:cut], key[:cut], fp[:cut])
            held = [(pair[cut:], key[cut:], fp[cut:])]
        if held:
            yield stars(*(np.concatenate(c) for c in zip(*held)))

    rows = variants(prints).repartition("pair", "key").sortWithinPartitions("pair", "key")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (signed long), fingerprint (16 hex digits), component_id: the smallest key of a
    document reachable over fingerprints that differ in at most 3 bits, itself included; root: the
    fp that names the component.

    Equal texts have equal fingerprints, are one node, and need no link. Texts without words have
    fingerprint 0 and are linked like any other. Rows with a null key have a component too, of the
    keys that are not null (null if there are none)."""
    prints = written(fingerprints(docs, key, text), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")), "simhash")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select(
        key, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest key stays (one
    row, if that key repeats). Of a component without any key one row stays."""
    groups = near_duplicates(docs, key, text)
    columns, gone, row = docs.columns, free_name(docs, "gone"), free_name(docs, "row")
    if has_plain_key(docs, key):
        others = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone))
        return docs.join(sent(written(others, "simhash-gone")), F.col(key) == F.col(gone), "left_anti").select(*columns)
    # Rows without a key of their own: find them by their fingerprint, too.
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = fingerprints(rows, row, text).select(F.col(row).alias("row"), F.col("fp").alias("row_fp"))
    named = groups.select("fp", "root", F.col("component_id").alias("least")).distinct()
    keys = rows.select(F.col(row).alias("number"), F.col(key).alias("key"))
    found = prints.join(named, F.col("row_fp") == F.col("fp")).join(keys, F.col("number") == F.col("row"))
    firsts = found.where(F.col("key").eqNullSafe(F.col("least"))).groupBy("root").agg(F.min("row").alias(gone))
    return rows.join(firsts.select(gone), F.col(row) == F.col(gone), "left_semi").select(*columns)
