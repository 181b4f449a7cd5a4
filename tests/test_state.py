"""The log state by blocks against line-by-line loops and against the operators over plain lines."""

import random

import pytest

from runsift.operators import clean, reduce
from runsift.operators.state import LogState, block_facts, log_state, marked_lines
from runsift.plans import executions as plans
from tests import brute

WORDS = ["A", "A", "A", "B", " A ", "", "Downloading x", "Progress: 5", "ok a", "FAIL b", "done"]


def random_logs(seed, n=30, longest=40, words=WORDS):
    rng = random.Random(seed)
    logs = {f"e{i}": rng.choices(words, k=rng.randint(1, longest)) for i in range(n)}
    logs["same"] = ["A"] * 23
    logs["noise"] = ["Downloading x"] * 9 + ["A"] + ["Downloading x"] * 4 + ["A"]
    logs["blank"] = ["", "  "]
    return logs


def state_of(lines, rows):
    marked = marked_lines(lines, rows)
    return LogState(marked, block_facts(marked))


def by_exec(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["exec_id"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 1000])
def test_lines_runs_samples_and_bytes(log, rows):
    logs = random_logs(rows)
    state = state_of(log(logs), rows)
    cleaned = {k: brute.clean(v) for k, v in logs.items()}
    cleaned = {k: v for k, v in cleaned.items() if v}
    assert by_exec(state.cleaned(), "line_no", "line") == cleaned
    assert by_exec(state.samples(4), "line_no", "line") == {k: v[:4] for k, v in cleaned.items()}
    assert by_exec(state.compressed(), "idx", "line") == {
        k: list(enumerate(brute.rle([line for _, line in v]))) for k, v in cleaned.items()
    }
    sizes = {r["exec_id"]: r["original_bytes"] for r in state.original_bytes().collect()}
    assert {k: v for k, v in sizes.items() if v} == {k: sum(len(line.encode()) + 1 for _, line in v) for k, v in cleaned.items()}


@pytest.mark.parametrize("rows", [3, 50])
def test_truncation(log, rows, monkeypatch):
    monkeypatch.setattr("runsift.operators.state.MAX_ROWS", 12)
    monkeypatch.setattr("runsift.operators.state.HEAD_ROWS", 4)
    monkeypatch.setattr("runsift.operators.state.TAIL_ROWS", 5)
    monkeypatch.setattr(reduce.truncate_indexed, "__defaults__", (12, 4, 5))
    logs = random_logs(9, longest=120, words=["A", "A", "B", "C", "Progress: 1"])
    found = by_exec(state_of(log(logs), rows).compressed(), "idx", "line")
    for k, v in logs.items():
        runs = brute.rle([line for _, line in brute.clean(v)])
        want = list(enumerate(brute.truncate(runs, 12, 4, 5, reduce.TRUNCATION_MARKER)))
        assert found.get(k, []) == want


def test_stored_state_equals_the_operators(log, spark):
    logs = random_logs(4, longest=300)
    state = log_state(log(logs), block_rows=16)
    plain = clean.clean_blocks(log(logs))
    assert by_exec(state.compressed(), "idx", "line") == by_exec(reduce.compress_lines(plain), "idx", "line")


def tool_logs(seed):
    rng = random.Random(seed)
    words = {
        "dotnet build": ["a(1,2): error CS1: m [p]", "b: warning CS2: y", "3 Error(s) 1 Warning(s)", "x", "x"],
        "gradle build": ["> Task :compileX", "e: bad", "> Task :clean", "FAILED", "FAILED"],
        "tsc": ["src/a.ts(1,2): error TS1: m", "src/a.ts(1,2): error TS1: m", "ok"],
        "git status": ["modified: a", "modified: a", "new file: b", "on branch c"],
        "make all": ["Error: x", "warn y", "warn y", "build complete", "vitest"],
        "vite build": ["error a", "error a", "12 modules transformed", "dist/x 1.5 KB"],
    }
    commands = list(words)
    logs, runs = {}, []
    for k in range(60):
        command = rng.choice(commands)
        logs[f"e{k}"] = rng.choices(words[command] + ["Downloading z"], k=rng.randint(1, 40))
        runs.append((f"e{k}", command, command.split()[0], k % 2, "2024-01-01 00:00:00", "2024-01-01 00:00:01"))
    return logs, runs


def test_records_do_not_depend_on_the_size_of_blocks(spark, log):
    logs, runs = tool_logs(5)
    executions = spark.createDataFrame(runs, "exec_id string, command_line string, cmd string, exit_code int, start_ts string, end_ts string").selectExpr(
        "exec_id", "command_line", "cmd", "exit_code", "timestamp(start_ts) AS start_ts", "timestamp(end_ts) AS end_ts"
    )
    lines = log(logs)

    def everything(rows):
        records = plans.execution_summary(executions, lines, block_rows=rows)
        events = plans.all_tool_events(executions, lines, block_rows=rows)
        parts = plans.summary_parts(executions, lines, rows_per_part=5, block_rows=rows)
        return [sorted(map(repr, df.collect())) for df in (records, events, parts)]

    whole = everything(1000)
    assert len(whole[0]) == len(runs) and len(whole[1]) > 100 and len(whole[2]) > 20
    assert everything(2) == whole
    assert everything(3) == whole


def test_many_tools_move_lines_instead_of_being_sent(spark, log, monkeypatch):
    logs, runs = tool_logs(6)
    executions = spark.createDataFrame(runs, "exec_id string, command_line string, cmd string, exit_code int, start_ts string, end_ts string").selectExpr(
        "exec_id", "command_line", "cmd", "exit_code", "timestamp(start_ts) AS start_ts", "timestamp(end_ts) AS end_ts"
    )
    sent = sorted(map(repr, plans.execution_summary(executions, log(logs), block_rows=4).collect()))
    monkeypatch.setattr(plans, "SENT_BYTES", 0)
    assert sorted(map(repr, plans.execution_summary(executions, log(logs), block_rows=4).collect())) == sent
