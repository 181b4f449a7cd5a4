"""Removal of every byte that a repeated string of WIDTH bytes covers, by suffix arrays of shards.

Shards. Equal strings must meet in one shard without all suffixes of the corpus being sorted
together. Every text gets anchors: the GRAM-byte strings whose hash is the least in some window of
WIDTH bytes. Which anchors a window has depends on its bytes alone, so equal windows share an
anchor at the same place. An anchor's context is all that windows around it can cover. From then on

* an anchor that occurs once has no repeated window (most text ends here, after two shuffles of
  short rows),
* a context that occurs more than once is repeated as a whole; copies in any number are merged
  before they are shuffled,
* distinct contexts of one anchor go to the anchor's shard, once each. A shard is a bounded number
  of bytes; its suffix array is induced, and permuted common prefixes of at least WIDTH with a
  neighbour in it tell the repeated windows,
* anchors and contexts that very many places share are looked up by broadcast and do not move,
* an anchor with more than CROWD distinct contexts (a frequent line in ever new surroundings) has
  no shard: the windows of its contexts are counted by their digests instead, which splits it.

Overlapping strings count, within one document too; strings never cross documents. Null texts
count as empty, texts shorter than WIDTH keep all bytes, repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import buckets_for, has_plain_key, joined_by_parts, sent, whole_text, written
from runsift.llm.suffix_array import END, GAP, common_prefixes, suffix_array, symbols

#: GRAM is a multiple of 8.
WIDTH, GRAM = 200, 32
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Distinct contexts of an anchor that go to one shard (3 MB of bytes); contexts of one shard on average.
CROWD, SHARD = 8000, 3000
#: Anchors, or contexts, with at least one in so many of all rows are hot: at most so many are.
HOT = 10_000


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over values[i : i + width] for each i where that fits."""
    n = len(values)
    fill = np.iinfo(np.uint64).max if take is np.minimum else 0
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    forward = take.accumulate(rows, axis=1).ravel()
    backward = take.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a text and the hashes of their `gram` bytes."""
    n = len(data)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram // 8):
        h = (h ^ words[8 * k : 8 * k + len(h)]) * np.uint64(FACTORS[k % 4])
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    windows = width - gram + 1
    least = _sliding(h, windows, np.minimum)
    # A position is an anchor if some window has no lesser hash: the largest of the window minima
    # around it is its own hash.
    around = np.concatenate([np.zeros(windows - 1, np.uint64), least, np.zeros(windows - 1, np.uint64)])
    at = np.flatnonzero(_sliding(around, windows, np.maximum) == h)
    return at, h[at]


def _context(at: int, n: int, width: int, gram: int) -> tuple[int, int]:
    return max(0, at - (width - gram)), min(n, at + width)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rid (one for each row), key and body. The key serves as rid where it is unique."""
    body = F.encode(whole_text(text), "UTF-8").alias("body")
    kind = dict(docs.dtypes)[key]
    if kind in ("bigint", "int") and has_plain_key(docs, key):
        return docs.select(F.col(key).cast("bigint").alias("rid"), F.col(key).alias("key"), body)
    staged = written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "repeats-rows")
    # Of a written table; numbers of its rows don't change when a task runs again.
    return written(staged.select(F.monotonically_increasing_id().alias("rid"), "key", F.encode(whole_text("text"), "UTF-8").alias("body")), "repeats-numbered")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with overlapping and touching ones merged."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return starts[new], reach[last]


def repeated_in_shard(rid: np.ndarray, start: np.ndarray, texts: list[bytes], width: int):
    """Spans (rid, start, end) covered by strings of `width` bytes that start at two places of the
    given pieces of documents. Pieces of one document that overlap or touch are joined first, so
    that each place occurs once."""
    order = np.lexsort((start, rid))
    pieces: list[tuple[int, int, bytearray]] = []
    for k in order.tolist():
        r, s, body = int(rid[k]), int(start[k]), texts[k]
        if pieces and pieces[-1][0] == r and s <= pieces[-1][1] + len(pieces[-1][2]):
            covered = pieces[-1][1] + len(pieces[-1][2]) - s
            pieces[-1][2].extend(body[covered:])
        else:
            pieces.append((r, s, bytearray(body)))
    sizes = np.array([len(p[2]) for p in pieces])
    t = np.empty(int(sizes.sum()) + len(pieces) + 1, np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    for (_, _, body), s, e in zip(pieces, starts.tolist(), ends.tolist()):
        t[s:e] = symbols(np.frombuffer(bytes(body), np.uint8))
    t[ends] = GAP
    t[-1] = END
    limit = np.repeat(np.r_[ends, len(t) - 1], np.r_[sizes + 1, 1]) - np.arange(len(t))
    before, common = common_prefixes(t, suffix_array(t), limit)
    hit = np.flatnonzero(common >= width)
    found = np.unique(np.concatenate([hit, before[hit]]))
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    s, e = _merged(found, found + width)
    of = np.searchsorted(ends, s)
    base = np.array([p[1] for p in pieces])[of] - starts[of]
    return np.array([p[0] for p in pieces], np.int64)[of], s + base, e + base


def repeated_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(rid, start, end) of `rows` (rid, body): bytes covered by strings of `width` bytes that
    start at two places or more. Spans may overlap each other."""
    import pyarrow as pa

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            gram_h, context_h, rids, places = [], [], [], []
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, h = anchors(body, width, gram)
                n = len(body)
                for a in at.tolist():
                    lo, hi = _context(a, n, width, gram)
                    # What stands left of the anchor is part of the digest.
                    context_h.append(xxh3_64_intdigest(body[lo:hi], a - lo))
                    places.append(a << 16 | hi - a)
                gram_h.append(h)
                rids += [rid] * len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(gram_h).view(np.int64) if gram_h else [], pa.int64()),
                    pa.array(np.array(context_h, np.uint64).view(np.int64)),
                    pa.array(rids, pa.int64()),
                    pa.array(places, pa.int64()),
                ],
                names=["gram", "context", "rid", "place"],
            )

    marked = written(
        rows.select("rid", "body").mapInArrow(find, "gram bigint, context bigint, rid bigint, place bigint"), "repeats-anchors"
    )
    # Few anchors have a large share of the places, and few contexts: those do not move.
    total = marked.count()
    grams = written(marked.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeats-grams")
    again = joined_by_parts(marked, grams, ["gram"], F.col("n") * HOT > total).drop("n")
    again = written(again, "repeats-again")
    # Copies are merged before they move.
    contexts = written(
        again.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("first")), "repeats-contexts"
    )
    copied = contexts.where("n > 1").select("gram", "context", "n")
    lo = F.greatest(F.lit(0), F.shiftright("place", 16) - (width - gram))
    hi = F.shiftright("place", 16) + F.col("place").bitwiseAND(0xFFFF)
    whole = joined_by_parts(again, copied, ["gram", "context"], F.col("n") * HOT > total).select(
        "rid", lo.alias("start"), hi.alias("end")
    )

    crowds = written(contexts.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "repeats-crowds")
    chosen = joined_by_parts(contexts, crowds, ["gram"], F.col("contexts") * HOT > total).select(
        "gram", "contexts", "first.rid", "first.place"
    )
    # The contexts of a document: no more than it has anchors.
    wanted = chosen.groupBy("rid").agg(F.collect_list(F.struct("gram", "contexts", "place")).alias("wanted"))
    wanted = written(wanted, "repeats-wanted")
    shards = buckets_for(contexts.count(), SHARD)
    joined = rows.select("rid", "body").join(sent(wanted, F.size("wanted")), "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, asked = batch.column(1), batch.column(2)
            for k, rid in enumerate(batch.column(0).to_pylist()):
                body, items = bodies[k].as_py(), asked[k].as_py()
                spans = [_context(i["place"] >> 16, len(body), width, gram) for i in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i["gram"] % shards for i in items], pa.int32()),
                        pa.array([i["contexts"] > crowd for i in items]),
                        pa.array([rid] * len(items), pa.int64()),
                        pa.array([lo for lo, _ in spans], pa.int64()),
                        pa.array([body[lo:hi] for lo, hi in spans], pa.binary()),
                    ],
                    names=["shard", "crowded", "rid", "start", "body"],
                )

    pieces = written(
        joined.mapInArrow(cut, "shard int, crowded boolean, rid bigint, start bigint, body binary"), "repeats-pieces"
    )

    def sort(table: pa.Table) -> pa.Table:
        rid, start, end = repeated_in_shard(
            table.column("rid").to_numpy(), table.column("start").to_numpy(), table.column("body").to_pylist(), width
        )
        return pa.table({"rid": rid, "start": start, "end": end})

    sorted_out = pieces.where("not crowded").select("shard", "rid", "start", "body").groupBy("shard").applyInArrow(
        sort, "rid bigint, start bigint, end bigint"
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for rid, start, body in zip(*(c.to_pylist() for c in batch.columns)):
                digests = [xxh3_128_intdigest(body[k : k + width]) for k in range(len(body) - width + 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d - (1 << 64) if (d := x >> 64) >> 63 else d for x in digests], pa.int64()),
                        pa.array([d - (1 << 64) if (d := x & (1 << 64) - 1) >> 63 else d for x in digests], pa.int64()),
                        pa.array([rid] * len(digests), pa.int64()),
                        pa.array(range(start, start + len(digests)), pa.int64()),
                    ],
                    names=["h1", "h2", "rid", "at"],
                )

    crowded = (
        pieces.where("crowded").select("rid", "start", "body")
        .mapInArrow(windows, "h1 bigint, h2 bigint, rid bigint, at bigint")
        .distinct()  # contexts of one document overlap
    )
    common = crowded.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    counted = crowded.join(common, ["h1", "h2"], "left_semi").select("rid", F.col("at").alias("start"), (F.col("at") + width).alias("end"))
    return whole.unionByName(sorted_out).unionByName(counted)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, bodies: bool = True
) -> DataFrame:
    """key, n_bytes, spans (removed runs as arrays of (start, end) in bytes), n_removed, n_spans,
    kept_sha256 of the remaining bytes and, with `bodies`, kept: those bytes (cut characters
    stay cut)."""
    import pyarrow as pa

    rows = _rows(docs, key, text)
    found = repeated_spans(rows, width, gram, crowd)
    # Spans of a document touch or overlap: at most one for each anchor or window of it.
    spans = written(found.distinct().groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("found")), "repeats-spans")
    joined = rows.join(sent(spans, F.size("found")), "rid", "left").select("key", "body", "found")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, sizes, removed, digests, rests = [], [], [], [], []
            lists = batch.column(2)
            ends = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64).cumsum()
            flat = lists.flatten()
            flat_s, flat_e = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = 0
            for k, body in enumerate(batch.column(1).to_pylist()):
                s, e = flat_s[at : ends[k]], flat_e[at : ends[k]]
                at = ends[k]
                if len(s):
                    s, e = (x.tolist() for x in _merged(s, e))
                    kept = b"".join([body[a:b] for a, b in zip([0, *e], [*s, len(body)])])
                else:
                    s, e, kept = [], [], body
                spans.append([{"start": a, "end": b} for a, b in zip(s, e)])
                sizes.append(len(body))
                removed.append(len(body) - len(kept))
                digests.append(hashlib.sha256(kept).hexdigest())
                rests.append(kept)
            made = [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(digests, pa.string()),
            ]
            names = ["key", "n_bytes", "spans", "n_removed", "n_spans", "kept_sha256"]
            if bodies:
                made.append(pa.array(rests, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(made, names=names)

    kind = dict(docs.dtypes)[key]
    schema = (
        f"key {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, n_spans bigint, kept_sha256 string"
        + (", kept binary" if bodies else "")
    )
    return joined.mapInArrow(drop, schema).withColumnRenamed("key", key)
