"""Keyed state for streaming logs: line dedupe, run lifecycle, heartbeats.

Each processor keeps a few scalars per execution. Calling Python for a key costs milliseconds, so
lines, numbers and heartbeats come in groups of many executions or blocks, each of which has an entry
of its own. So do reading and writing a value of the state, and small entries share one (`Entries`); a
micro-batch reads and writes the entries of its own rows and few beside them. Text work (escapes, trimming, patterns) stays
in Column expressions before the state; Python only compares neighbours. Times come and go as
microseconds since the epoch, so neither the session's time zone nor a rounding touches them.
Rows of one execution inside one micro-batch are ordered here, so bound the batch with the rate
limit of the source.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Entries:
    """Small values by key within a group, many of which are one value of the state: a bucket of those
    whose keys have one hash. When a bucket is over-full their number doubles, so that a call reads and
    writes at most some FULL entries for each of its keys, however many the group has.

    An entry is forgotten `keep_ms` after it was set; never if that is None. A call begins with `read`
    and ends with `write`; or, where keys need nothing of each other, it goes through `parts`."""

    FULL = 128

    def __init__(self, handle: StatefulProcessorHandle, name: str, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms
        # A bucket is kept as long as the last entry that was set in it.
        self.buckets = handle.getMapState(name, "bucket int", "entries binary", keep_ms)
        self.many = handle.getValueState(f"{name}_many", "many int")

    def read(self, keys: Iterable, timerValues) -> None:
        self.now = None if self.keep_ms is None else timerValues.getCurrentProcessingTimeInMs()
        known = self.many.get()
        self.n, self.loaded, self.changed = known[0] if known else 1, {}, set()
        for key in keys:
            self._load(self._bucket(key))

    def _bucket(self, key) -> int:
        return zlib.crc32(repr(key).encode("utf-8", "surrogatepass")) % self.n

    def _load(self, bucket: int) -> None:
        if bucket not in self.loaded:
            known = self.buckets.getValue((bucket,))
            entries = pickle.loads(known[0]) if known else {}
            if self.now is not None:
                entries = {key: entry for key, entry in entries.items() if entry[0] + self.keep_ms > self.now}
            self.loaded[bucket] = entries

    def get(self, key):
        entry = self.loaded[self._bucket(key)].get(key)
        return None if entry is None else entry[1]

    def set(self, key, value) -> None:
        bucket = self._bucket(key)
        self.loaded[bucket][key] = (self.now, value)
        self.changed.add(bucket)

    def remove(self, key) -> None:
        bucket = self._bucket(key)
        self.loaded[bucket].pop(key, None)
        self.changed.add(bucket)

    def write(self) -> None:
        fullest = max((len(self.loaded[b]) for b in self.changed), default=0)
        if fullest > self.FULL:
            for bucket in range(self.n):
                self._load(bucket)
            before, entries = self.n, [entry for some in self.loaded.values() for entry in some.items()]
            while self.n * self.FULL < 2 * len(entries) or self.n == before:
                self.n *= 2
            self.loaded = {bucket: {} for bucket in range(self.n)}
            for key, entry in entries:
                self.loaded[self._bucket(key)][key] = entry
            self.changed = set(self.loaded)
            self.many.update((self.n,))
        self._store()

    def _store(self) -> None:
        for bucket in self.changed:
            if self.loaded[bucket]:
                self.buckets.updateValue((bucket,), (pickle.dumps(self.loaded[bucket]),))
            elif self.buckets.containsKey((bucket,)):
                self.buckets.removeKey((bucket,))

    def parts(self, keys: Iterable, timerValues) -> Iterator[list]:
        """The keys of one bucket after the other. A bucket is read before its turn and written behind
        it, so that of the entries no more than one bucket is held."""
        self.read((), timerValues)
        of, held, fullest = {}, 0, 0
        for key in keys:
            of.setdefault(self._bucket(key), []).append(key)
        for bucket, some in of.items():
            self.loaded, self.changed = {}, set()
            self._load(bucket)
            yield some
            held, fullest = held + len(self.loaded[bucket]), max(fullest, len(self.loaded[bucket]))
            self._store()
        if fullest > self.FULL:
            self._spread(held / len(of))

    def _spread(self, mean: float) -> None:
        """More buckets, for as many entries as the `mean` of a bucket tells. Their number is doubled, so
        that a bucket goes to buckets of its own."""
        before = self.n
        while self.n == before or self.n * self.FULL < 2 * before * mean:
            self.n *= 2
        for bucket in range(before):
            self.loaded = {}
            self._load(bucket)
            entries = self.loaded[bucket]
            self.loaded = {to: {} for to in range(bucket, self.n, before)}
            for key, entry in entries.items():
                self.loaded[self._bucket(key)][key] = entry
            self.changed = set(self.loaded)
            self._store()
        self.many.update((self.n,))


class LastNumbers(StatefulProcessor):
    """Tells every block of an execution that has lines in a micro-batch the last number that the
    execution had before it. Only numbers come here; those that are missing have `has` unset.

    The number is forgotten `keep_ms` after it came; never if that is None."""

    NONE = -(1 << 63)

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Entries(handle, "last", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for chunk in rows:
            numbers = chunk["number"].where(chunk["has"], self.NONE)
            parts.append(numbers.groupby([chunk["who"], chunk["block"]]).max().rename("number").reset_index())
        blocks = pd.concat(parts).groupby(["who", "block"], as_index=False)["number"].max()
        floors, tops = {}, blocks.groupby("who")["number"].max()
        self.last.read(tops.index, timerValues)
        for who, highest in tops.items():
            before = self.last.get(who)
            floors[who] = self.NONE if before is None else before
            if highest > floors[who]:
                self.last.set(who, int(highest))
        self.last.write()
        yield blocks.assign(floor=[floors[who] for who in blocks["who"]])[["who", "block", "floor"]]

    def close(self) -> None:
        pass


class DedupeBlocks(StatefulProcessor):
    """Drops a line equal to the previous one of its block and flags lines behind the floor.

    kind 0: a row of the result. kind 1: the first line that a block ever has, which the line before
    the block decides; kind 2: the last line of the block so far. What a block knows is its last line,
    forgotten `keep_ms` after it came."""

    ROW, HEAD, TAIL = 0, 1, 2

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Entries(handle, "last", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        batch["at"] = batch.groupby(["who", "block"]).ngroup()
        floor = batch["floor"].groupby(batch["at"]).transform("max")
        text = batch["line"].notna()
        late = text & (~batch["has"] | (batch["number"] <= floor))
        fresh = batch[text & ~late].sort_values(["at", "number"])
        at, line = fresh["at"].to_numpy(), fresh["line"].to_numpy()
        new = np.diff(at, prepend=-1) != 0
        kept = new | (line != np.roll(line, 1))
        kinds = np.full(len(fresh), self.ROW)
        firsts = np.flatnonzero(new)
        lasts = np.r_[firsts[1:], len(fresh)][: len(firsts)] - 1
        blocks = list(zip(fresh["who"].iloc[firsts], fresh["block"].iloc[firsts].tolist()))
        self.last.read(blocks, timerValues)
        for first, last, block in zip(firsts, lasts, blocks):
            before = self.last.get(block)
            if before is None:
                kinds[first] = self.HEAD
            else:
                kept[first] = line[first] != before
            self.last.set(block, line[last])
        self.last.write()
        out = pd.concat(
            [
                fresh.assign(late=False, kind=kinds)[kept],
                batch[late].assign(late=True, kind=self.ROW),
                fresh.iloc[lasts].assign(late=False, kind=self.TAIL),
            ]
        )
        yield out[["who", "block", "number", "has", "line", "late", "kind"]]

    def close(self) -> None:
        pass


class Borders(StatefulProcessor):
    """Decides the first lines of blocks by the line before. Groups below `groups` are of executions
    and have the rows at the ends of blocks, of which a micro-batch has two for each block; all other
    rows come in groups of their own and pass."""

    def __init__(self, keep_ms: int | None, groups: int) -> None:
        self.keep_ms, self.groups = keep_ms, groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Entries(handle, "last", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        columns = ["who", "number", "has", "line", "late"]
        if key[0] >= self.groups:
            for chunk in rows:
                yield chunk[columns]
            return
        ends = pd.concat(list(rows), ignore_index=True).sort_values(["who", "block", "kind"])
        self.last.read(ends["who"].unique(), timerValues)
        kept, of, before = [], None, None
        for place, who, line, kind in zip(ends.index, ends["who"], ends["line"], ends["kind"]):
            if who != of:
                if of is not None:
                    self.last.set(of, before)
                of, before = who, self.last.get(who)
            if kind == DedupeBlocks.HEAD:
                if line != before:
                    kept.append(place)
            else:
                before = line
        self.last.set(of, before)
        self.last.write()
        yield ends.loc[kept, columns]

    def close(self) -> None:
        pass


class RunLifecycle(StatefulProcessor):
    """One closing row per execution: at its exit event, or when it outlives the timeout.

    Of the log lines only the first time is used; chunks of a batch are never put together. A group
    has a timer for each millisecond at which some run of it is due, and the names of these runs."""

    TIMED_OUT = -1

    def __init__(self, timeout_us: int) -> None:
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # start_us, closed, last_no
        self.run = Entries(handle, "run")
        self.due = handle.getMapState("due", "at_ms bigint", "who array<string>")

    def _closings(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["who", "start_us", "end_us", "exit_code", "timed_out", "last_no"])
        return out.astype({"exit_code": "Int32"})

    def _timers(self, due: dict[int, list[str]]) -> None:
        for at_ms, names in due.items():
            before = self.due.getValue((at_ms,))
            if before is None:
                self.handle.registerTimer(at_ms)
            self.due.updateValue((at_ms,), ([*(before[0] if before else ()), *names],))

    def _due(self, at_us: int) -> int:
        # Timers have milliseconds; never early.
        return -(-at_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        seen = {}
        for chunk in rows:
            exits = chunk[chunk["exit_code"].notna()]
            exits = exits.loc[exits.groupby("who")["at"].idxmin()].set_index("who")
            of = chunk.groupby("who")
            for who, low, number in zip(*self._columns(of["at"].min(), of["line_no"].max())):
                first, last_no, exit_at, exit_code = seen.get(who, (low, -1, None, None))
                seen[who] = (min(first, low), last_no if number is None else max(last_no, number), exit_at, exit_code)
            for who, at, code in zip(*self._columns(exits["at"], exits["exit_code"])):
                first, last_no, exit_at, exit_code = seen[who]
                if exit_at is None or at < exit_at:
                    seen[who] = (first, last_no, at, code)
        out, due = [], {}
        self.run.read(seen, timerValues)
        for who, (first, last_no, exit_at, exit_code) in seen.items():
            known = self.run.get(who)
            start_us, closed, before = known or (first, False, -1)
            if known is None:
                due.setdefault(self._due(start_us + self.timeout_us), []).append(who)
            last_no = max(last_no, before)
            # The open timer stays: it clears the state of a closed run.
            ends = not closed and exit_at is not None
            self.run.set(who, (start_us, closed or ends, last_no))
            if ends:
                limit = start_us + self.timeout_us
                overdue = exit_at > limit
                out.append((who, start_us, limit if overdue else exit_at, self.TIMED_OUT if overdue else exit_code, overdue, last_no))
        self.run.write()
        self._timers(due)
        if out:
            yield self._closings(out)

    @staticmethod
    def _columns(first: pd.Series, second: pd.Series) -> tuple[list, ...]:
        """The names, and whole numbers or None."""
        return first.index.tolist(), [int(x) for x in first], [None if pd.isna(x) else int(x) for x in second]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at_ms = expiredTimerInfo.getExpiryTimeInMs()
        (names,) = self.due.getValue((at_ms,))
        self.due.removeKey((at_ms,))
        out, due = [], {}
        self.run.read(names, timerValues)
        for who in names:
            start_us, closed, last_no = self.run.get(who)
            if closed:
                self.run.remove(who)
                continue
            # Keep the closed mark for one more timeout, so that stragglers do not reopen the run.
            self.run.set(who, (start_us, True, last_no))
            end_us = start_us + self.timeout_us
            due.setdefault(self._due(end_us + self.timeout_us), []).append(who)
            out.append((who, start_us, end_us, self.TIMED_OUT, True, last_no))
        self.run.write()
        self._timers(due)
        if out:
            yield self._closings(out)

    def close(self) -> None:
        pass


class HoldLines(StatefulProcessor):
    """Lines of blocks of executions, held until the closing of their execution comes; then they leave
    with it.

    A micro-batch adds one value to each of its blocks, the lines as compressed Arrow data. A closed
    block lets nothing more in: what comes behind the closing is left out."""

    FIELDS = ("line_no", "line", "at")
    END = ("start_us", "end_us", "exit_code", "timed_out")
    SCHEMA = pa.schema([("line_no", pa.int64()), ("line", pa.string()), ("at", pa.int64())])
    CLOSED = -1
    #: Lines that leave together.
    TOGETHER = 1 << 16

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The values of a block are numbered; a closed block has CLOSED of them.
        self.held = handle.getMapState("held", "who string, block bigint, piece int", "lines binary")
        self.pieces = Entries(handle, "pieces")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        ends = batch["end_us"].notna()
        closings = {(who, block): end for who, block, *end in batch.loc[ends, ["who", "block", *self.END]].itertuples(index=False)}
        lines = batch[~ends]
        lines = lines.assign(of=lines.groupby(["who", "block"]).ngroup()).sort_values("of", kind="stable")
        firsts = np.flatnonzero(np.diff(lines["of"].to_numpy(), prepend=-1))
        table = pa.Table.from_pandas(lines[list(self.FIELDS)], schema=self.SCHEMA, preserve_index=False)
        blocks = zip(lines["who"].iloc[firsts], lines["block"].iloc[firsts])
        fresh = {of: table.slice(at, n) for of, at, n in zip(blocks, firsts, np.diff(firsts, append=len(lines)))}
        out, size = [], 0
        self.pieces.read({**fresh, **closings}, timerValues)
        for of in {**fresh, **closings}:
            pieces = self.pieces.get(of) or 0
            if pieces == self.CLOSED:
                continue
            if of not in closings:
                data = pa.BufferOutputStream()
                with pa.ipc.new_stream(data, self.SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(fresh[of])
                self.held.updateValue((*of, pieces), (data.getvalue().to_pybytes(),))
                self.pieces.set(of, pieces + 1)
                continue
            leaving = []
            for piece in range(pieces):
                (data,) = self.held.getValue((*of, piece))
                with pa.ipc.open_stream(data) as reader:
                    leaving.append(reader.read_all())
                self.held.removeKey((*of, piece))
            if of in fresh:
                leaving.append(fresh[of])
            self.pieces.set(of, self.CLOSED)
            out.append((of, leaving, closings[of]))
            size += sum(map(len, leaving))
            if size >= self.TOGETHER:
                yield self._out(out)
                out, size = [], 0
        self.pieces.write()
        if out:
            yield self._out(out)

    def _out(self, closed: list[tuple]) -> pd.DataFrame:
        """The lines of blocks with the closing of their execution; its row without a line number
        comes with its first block."""
        lines = pa.concat_tables([self.SCHEMA.empty_table(), *(t for _, tables, _ in closed for t in tables)]).to_pandas()
        lines["k"] = np.repeat(np.arange(len(closed)), [sum(map(len, tables)) for _, tables, _ in closed])
        ends = pd.DataFrame([(of[0], *end) for of, _, end in closed], columns=["who", *self.END])
        lines = lines.merge(ends, left_on="k", right_index=True)
        # Lines that came after the end of a run that was timed out are not part of it.
        lines = lines[lines["at"] <= lines["end_us"]]
        firsts = ends[[of[1] == 0 for of, _, _ in closed]]
        both = pd.concat([firsts.assign(line_no=None, line=None).astype({"line_no": "Int64"}), lines.astype({"line_no": "Int64"})], ignore_index=True)
        kinds = {"start_us": "Int64", "end_us": "Int64", "exit_code": "Int32", "timed_out": "boolean"}
        return both.astype(kinds)[["who", "line_no", "line", *self.END]]

    def close(self) -> None:
        pass


class Heartbeat(StatefulProcessor):
    """A row whenever a line comes more than `every_us` after the last beat (first: the start).

    The last beat of an execution is forgotten `keep_ms` after it was set; never if that is None."""

    def __init__(self, every_us: int, keep_ms: int | None) -> None:
        self.every_us = every_us
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.beat = Entries(handle, "beat", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        # Of the names each is held once.
        names, of, at = {}, [], []
        for chunk in rows:
            codes, found = pd.factorize(chunk["who"])
            of.append(np.array([names.setdefault(who, len(names)) for who in found])[codes])
            at.append(chunk["at"].to_numpy())
        of, at = np.concatenate(of), np.concatenate(at)
        order = np.lexsort((at, of))
        at = at[order]
        ends = np.cumsum(np.bincount(of, minlength=len(names)))
        beats = []
        for who in itertools.chain.from_iterable(self.beat.parts(names, timerValues)):
            k = names[who]
            times = at[ends[k - 1] if k else 0 : ends[k]]
            before = self.beat.get(who)
            last = int(times[0]) if before is None else before
            # From beat to beat; lines between them are not looked at.
            place = times.searchsorted(last + self.every_us, side="right")
            while place < len(times):
                now = int(times[place])
                beats.append((who, now, (now - last) // 1000))
                last = now
                place = times.searchsorted(last + self.every_us, side="right")
            # With an expiry, a beat is kept as long as lines come.
            if last != before or self.keep_ms is not None:
                self.beat.set(who, last)
        if beats:
            yield pd.DataFrame(beats, columns=["who", "at", "since_ms"])

    def close(self) -> None:
        pass
