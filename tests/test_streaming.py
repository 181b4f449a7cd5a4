"""Streaming results equal batch results; late lines, timeouts and heartbeats."""

import pickle
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runsift.operators import clean
from runsift.streaming import jobs, stateful
from workload import streams

SCHEMA = "exec_id string, line_no bigint, line string, ts timestamp, exit_code int"


def arrivals(spark, tmp_path, batches):
    """One JSON file per micro-batch, in order."""
    path = tmp_path / "in"
    for rows in batches:
        df = spark.createDataFrame(
            [(e, n, line, ts, code) for e, n, line, ts, code in rows],
            "exec_id string, line_no bigint, line string, ts string, exit_code int",
        )
        df.coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))


def collect(stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.000Z"


def line(e, n, text, second=0):
    return (e, n, text, at(second), None)


def test_clean_stream(spark, tmp_path, log):
    texts = ["A", "A", "Downloading x", "A", "", "B", "B", "C"]
    batches = [
        [line("e", i, t) for i, t in enumerate(texts[:3])],
        [line("e", i + 3, t) for i, t in enumerate(texts[3:6])],
        [line("e", 6, "B"), line("e", 7, "C"), line("e", 2, "late")],
    ]
    rows = collect(jobs.clean_stream(arrivals(spark, tmp_path, batches)), "cleaned", tmp_path)
    batch = clean.clean_lines(log({"e": texts})).collect()
    on_time = sorted((r["line_no"], r["line"]) for r in rows if not r["late"])
    assert on_time == sorted((r["line_no"], r["line"]) for r in batch)
    assert [(r["line_no"], r["line"]) for r in rows if r["late"]] == [(2, "late")]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_clean_stream_by_blocks(spark, tmp_path, rows):
    dice = random.Random(rows)
    batches, want, late = [], [], []
    state = {e: (-1, None) for e in "abc"}
    left = {e: list(enumerate(dice.choices(["A", "A", "B", "", "Downloading x"], k=30))) for e in "abc"}
    for n in range(4):
        batch = []
        for e in "abc":
            some = left[e][: dice.randrange(1, 12)]
            left[e] = left[e][len(some) :]
            again = [(k, "late") for k in range(min(n, 2))]
            batch += [line(e, k, t) for k, t in some + again]
            last, before = state[e]
            fresh = sorted((k, t) for k, t in some + again if t and k > last)
            late += [(e, k, t) for k, t in some + again if t and k <= last]
            for k, t in fresh:
                if t != before and not t.startswith("Downloading"):
                    want.append((e, k, t))
                before = t
            state[e] = (max([last, *[k for k, _ in fresh]]), before)
        dice.shuffle(batch)
        batches.append(batch)
    stream = jobs.clean_stream(arrivals(spark, tmp_path, batches), block_rows=rows)
    found = collect(stream, f"cleaned_{rows}", tmp_path)
    assert sorted((r["exec_id"], r["line_no"], r["line"]) for r in found if not r["late"]) == sorted(want)
    assert sorted((r["exec_id"], r["line_no"], r["line"]) for r in found if r["late"]) == sorted(late)


def test_closed_logs_hold_their_lines(spark, tmp_path):
    batches = [
        [line("a", k, f"a{k}", k) for k in range(5)] + [line("b", 0, "b0", 0)],
        [line("a", 5, "a5", 6), ("a", None, None, at(7), 3), line("b", 1, "b1", 8)],
        [line("a", 6, "behind", 9), line("b", 2, "b2", 20)],
        [line("c", 0, "c0", 300)],
        [line("c", 1, "c1", 301), ("d", None, None, at(302), 0)],
    ]
    stream = jobs.closed_logs(arrivals(spark, tmp_path, batches), timeout_seconds=15, block_rows=2)
    rows = collect(stream, "closed_logs", tmp_path)
    lines = sorted((r["exec_id"], r["line_no"], r["line"]) for r in rows if r["line_no"] is not None)
    # b ends 15 seconds after its start; its line at 20 seconds is not part of it.
    assert [x for x in lines if x[0] == "a"] == [("a", k, f"a{k}") for k in range(6)]
    assert [x for x in lines if x[0] == "b"] == [("b", 0, "b0"), ("b", 1, "b1")]
    ends = {r["exec_id"]: (r["exit_code"], r["timed_out"]) for r in rows if r["line_no"] is None}
    assert ends["a"] == (3, False) and ends["b"] == (-1, True) and ends["d"] == (0, False)


def test_closings(spark, tmp_path):
    batches = [
        [line("exits", 0, "x", 0), line("hangs", 0, "x", 0)],
        [("exits", None, None, at(5), 3), line("tick", 0, "x", 5)],
        [line("tick", 1, "x", 100)],
        [line("tick", 2, "x", 101)],
    ]
    stream = jobs.closings(arrivals(spark, tmp_path, batches), timeout_seconds=60)
    rows = {r["exec_id"]: r for r in collect(stream, "closed", tmp_path)}
    assert (rows["exits"]["exit_code"], rows["exits"]["timed_out"]) == (3, False)
    assert (rows["hangs"]["exit_code"], rows["hangs"]["timed_out"]) == (-1, True)


def test_heartbeats(spark, tmp_path):
    seconds = [0, 3, 6, 9, 30, 31]
    batches = [[line("e", i, "x", s)] for i, s in enumerate(seconds)]
    stream = jobs.heartbeats(arrivals(spark, tmp_path, batches), every_seconds=5)
    rows = collect(stream.withColumn("s", F.second("ts")), "beats", tmp_path)
    assert [(r["s"], r["since_ms"]) for r in sorted(rows, key=lambda r: r["ts"])] == [(6, 6000), (30, 24000)]


def test_counters(spark, tmp_path):
    batches = [[("a", None, None, at(0), 0)], [("b", None, None, at(1), 1)]]
    query = (
        jobs.counters(arrivals(spark, tmp_path, batches))
        .writeStream.format("memory")
        .queryName("totals")
        .outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    row = spark.table("totals").first()
    assert (row["commands_executed"], row["command_failures"]) == (2, 1)


@pytest.mark.parametrize("groups", [1, 7])
def test_many_executions_go_to_python_in_groups(spark, tmp_path, monkeypatch, groups):
    """Executions that share a call of Python keep their own lines, numbers and beats."""
    monkeypatch.setattr(jobs, "GROUPS", groups)
    names = ["", "=", "a", "é", None, *map(str, range(20))]
    first = [line(e, n, f"x{n // 2}", n) for e in names for n in range(5)]
    second = [line(e, n, f"x{n // 2}", 10 * n) for e in names[:6] for n in (5, 6)]
    late = [line("a", 1, "late", 70), line("é", None, "none", 70)]
    batches = [first, second + late]
    stream = arrivals(spark, tmp_path, batches)
    rows = collect(jobs.clean_stream(stream, block_rows=2), "grouped", tmp_path)
    want = [(e, n, f"x{n // 2}", False) for e in names for n in (0, 2, 4)]
    want += [(e, 6, "x3", False) for e in names[:6]] + [("a", 1, "late", True), ("é", None, "none", True)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    beats = collect(jobs.heartbeats(stream, 5), "grouped_beats", tmp_path / "beats")
    want = [(e, ms) for e in names[:6] for ms in (50_000, 10_000)] + [("a", 10_000), ("é", 10_000)]
    assert sorted(((r["exec_id"], r["since_ms"]) for r in beats), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("groups", [1, 7])
def test_runs_and_held_lines_go_to_python_in_groups(spark, tmp_path, monkeypatch, groups):
    """Runs that share a call of Python, and a timer, keep their own ends and lines."""
    monkeypatch.setattr(jobs, "GROUPS", groups)
    names = ["", "=", "é", None, *map(str, range(8))]
    first = [line(e, n, f"{e}{n}", n) for e in names for n in range(3)]
    second = [line(e, 3, None, 4) for e in names] + [(e, None, None, at(5), 2) for e in names[:6]] + [line("0", 4, "same batch", 5)]
    third = [line(e, 5, "behind", 30) for e in names]
    batches = [first, second, third, [line("z", 0, "z", 300)], [line("z", 1, "z", 301)]]
    stream = jobs.closed_logs(arrivals(spark, tmp_path, batches), timeout_seconds=15, block_rows=2)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithState") == 2 and plan.count("pmod(xxhash64(") == 2
    rows = [r for r in collect(stream, f"held_{groups}", tmp_path) if r["exec_id"] != "z"]
    lines = [(r["exec_id"], r["line_no"], r["line"]) for r in rows if r["line_no"] is not None]
    want = [(e, n, f"{e}{n}") for e in names for n in range(3)] + [(e, 3, None) for e in names] + [("0", 4, "same batch")]
    assert sorted(lines, key=repr) == sorted(want, key=repr)
    ends = [(r["exec_id"], r["exit_code"], r["timed_out"], r["end_us"] - r["start_us"]) for r in rows if r["line_no"] is None]
    want = [(e, 2, False, 5_000_000) for e in names[:6]] + [(e, -1, True, 15_000_000) for e in names[6:]]
    assert sorted(ends, key=repr) == sorted(want, key=repr)


class Values(dict):
    """A map or a value of a state, with the number of its reads and writes."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Store:
    def __init__(self):
        self.values, self.many = Values(), Value()

    def getMapState(self, name, key, value, keep_ms):
        return self.values

    def getValueState(self, name, value):
        return self.many

    def getCurrentProcessingTimeInMs(self):
        return self.now


@pytest.mark.parametrize("keep", [None, 50])
def test_small_values_of_a_state_share_reads_and_writes(keep):
    dice, store, want = random.Random(1), Store(), {}
    for n in range(300):
        store.now = 10 * n
        # As in a new call, which may run in another process.
        entries = stateful.Entries(store, "x", keep)
        keys = dice.sample([("é", k) for k in range(3000)], 60)
        entries.read(keys, store)
        before = store.values.calls
        for key in keys:
            at, value = want.get(key, (None, None))
            assert entries.get(key) == (None if at is None or keep and at + keep <= store.now else value)
            if n % 3 == 2:
                entries.remove(key)
                want.pop(key, None)
            else:
                entries.set(key, n)
                want[key] = store.now, n
        assert store.values.calls == before
        entries.write()
    assert keep or len(store.values) > 8
    sizes = [len(pickle.loads(some[0])) for some in store.values.values()]
    assert max(sizes) <= stateful.Entries.FULL


def test_stretches_of_time_arrive_one_by_one(spark, tmp_path, monkeypatch):
    """No event is older than what came in an earlier micro-batch, and the session's number of
    partitions is not the one of the state."""
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    spark.range(2400).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "id % 50 AS user_id", "'a' AS event_type", "1D AS value", "'' AS props"
    ).write.parquet(str(tmp_path / "events.parquet"))
    arrivals = streams.replay(spark, str(tmp_path))
    assert arrivals.files > 1
    spans, states = [], []

    def keep(batch, batch_id):
        spans.append(batch.agg(F.min("ts"), F.max("ts"), F.count("*")).first())
        states.append(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        streams.run(spark, streams.arriving(spark, arrivals).writeStream.foreachBatch(keep))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "77"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(spans) >= streams.PERIODS and sum(n for _, _, n in spans) == 2400 + 50
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert set(states) == {str(spark.sparkContext.defaultParallelism)}


@pytest.mark.parametrize("keep", [None, 50])
def test_keys_go_through_the_buckets_one_by_one(keep):
    dice, store, want = random.Random(2), Store(), {}
    for n in range(120):
        store.now = 10 * n
        entries = stateful.Entries(store, "x", keep)
        # The first call has most keys, so that one bucket becomes many at once.
        keys = dice.sample([("é", k) for k in range(3000)], 60 if n else 1500)
        seen = []
        for some in entries.parts(keys, store):
            assert len(entries.loaded) == 1
            for key in some:
                at, value = want.get(key, (None, None))
                assert entries.get(key) == (None if at is None or keep and at + keep <= store.now else value)
                entries.set(key, n)
                want[key] = store.now, n
            seen += some
        assert sorted(seen) == sorted(keys)
        assert list(entries.parts([], store)) == []
    known = {key: n for some in store.values.values() for key, (_, n) in pickle.loads(some[0]).items()}
    assert known.items() <= {key: n for key, (_, n) in want.items()}.items() and (keep or len(known) == len(want))
    assert max(len(pickle.loads(some[0])) for some in store.values.values()) <= 2 * stateful.Entries.FULL


@pytest.mark.parametrize("keep", [None, 50_000])
def test_beats_share_reads_and_writes(keep):
    """Beats of many executions cost few calls of the state, and are those that a loop over the lines finds."""
    dice, every = random.Random(3), 5_000_000
    names = ["", "=", "=é", *(f"={k}" for k in range(600))]
    store, lasts, want, found, rounds = Store(), {}, [], [], []
    for n in range(6):
        store.now = 40_000 * n
        lines = [(0, who, (40 * n + dice.randrange(40)) * 1_000_000) for who in dice.sample(names, 400 if n % 2 else 603) for _ in range(dice.randrange(1, 6))]
        lines += lines[:50]
        dice.shuffle(lines)
        for who, times in sorted((w, sorted(at for _, x, at in lines if x == w)) for w in {w for _, w, _ in lines}):
            set_at, last = lasts.get(who, (None, None))
            if last is None or keep and set_at + keep <= store.now:
                last = times[0]
            for at in times:
                if at > last + every:
                    want.append((who, at, (at - last) // 1000))
                    last = at
            lasts[who] = store.now, last
        beat = stateful.Heartbeat(every, keep)
        beat.init(store)
        before = store.values.calls
        chunks = [pd.DataFrame(lines[k : k + 500], columns=["part", "who", "at"]) for k in range(0, len(lines), 500)]
        found += [row for out in beat.handleInputRows((0,), iter(chunks), store) for row in out.itertuples(index=False, name=None)]
        rounds.append(store.values.calls - before)
    assert sorted(found) == sorted(want) and len(want) > 1000
    assert max(rounds) < 100
    # Lines that bring no beat write nothing, unless a beat must be kept on.
    before = store.values.calls
    quiet = [(0, who, at) for who, (_, at) in lasts.items()]
    assert list(beat.handleInputRows((0,), iter([pd.DataFrame(quiet, columns=["part", "who", "at"])]), store)) == []
    calls = store.values.calls - before
    assert (calls <= len(store.values)) == (keep is None)
