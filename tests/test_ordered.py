"""Ordered operators on random logs with tiny blocks, against a line-by-line loop."""

import random

import pytest
from pyspark.sql import functions as F

from runsift.operators import clean, folds, reduce
from runsift.operators.blocks import number_rows
from runsift.operators.families import BY_NAME
from tests import brute

ALPHABET = [
    "A", "B", " A ", "", "   ", "Downloading x", "Progress: 5", "ok a", "FAIL b", "✓ c", "PASS d",
    "pass", "done",
]


def random_logs(words, seed, n=25, longest=40):
    rng = random.Random(seed)
    logs = {f"e{i}": rng.choices(words, k=rng.randint(1, longest)) for i in range(n)}
    logs["same"] = [words[0]] * 20
    return logs


def rows(df, *columns):
    out = {}
    for row in df.orderBy("exec_id", columns[0]).collect():
        out.setdefault(row["exec_id"], []).append(tuple(row[c] for c in columns))
    return out


def texts(df):
    return {k: [line for _, line in v] for k, v in rows(df, "idx", "line").items()}


def test_clean_lines(log, small_blocks):
    logs = random_logs(ALPHABET, 1)
    expected = {k: brute.clean(v) for k, v in logs.items()}
    assert rows(clean.clean_lines(log(logs)), "line_no", "line") == {
        k: v for k, v in expected.items() if v
    }


def test_noise_breaks_a_run(log, small_blocks):
    df = clean.clean_blocks(log({"e": ["A", "Downloading x", "A"]}))
    assert texts(reduce.rle_lines(df)) == {"e": ["A (Repeated 2 times)"]}


def test_rle_lines(log, small_blocks):
    logs = random_logs(["A", "A", "A", "B"], 2)
    result = rows(reduce.rle_lines(log(logs)), "idx", "line")
    for k, lines in logs.items():
        assert result[k] == list(enumerate(brute.rle(lines)))


def test_truncate(log, small_blocks):
    logs = random_logs([str(i) for i in range(100)], 3)
    result = rows(reduce.truncate_head_tail(log(logs), 12, 4, 5), "idx", "line")
    for k, lines in logs.items():
        kept = brute.truncate(lines, 12, 4, 5, reduce.TRUNCATION_MARKER)
        assert result[k] == list(enumerate(kept))


def test_group_pass_fail(log, small_blocks):
    words = ["ok a", "FAIL b", "✓ c", "PASS d", "passed", "x"]
    logs = random_logs(words, 4)
    logs["spec"] = ["ok a", "FAIL b", "ok c", "done"]
    result = texts(reduce.group_pass_fail(log(logs)))
    assert result == {k: brute.group_results(v) for k, v in logs.items()}
    assert result["spec"] == ["✓ 2 tests passed", "✗ 1 tests failed", "done"]


def test_reduce_lines(log, small_blocks):
    logs = random_logs(ALPHABET, 5)
    expected = {}
    for k, v in logs.items():
        compressed = brute.rle([line for _, line in brute.clean(v)])
        deduped = [x for i, x in enumerate(compressed) if i == 0 or x != compressed[i - 1]]
        expected[k] = brute.group_results(deduped)
    result = texts(reduce.reduce_lines(clean.clean_blocks(log(logs))))
    assert result == {k: v for k, v in expected.items() if v}


def fold(df, name):
    return {r["exec_id"]: r for r in folds.fold_as(df, BY_NAME[name]).collect()}


def effects_of(df, name):
    keys = {"fam": F.lit(0), "argument": F.lit("status")}
    return folds.line_effects(clean.into_blocks(df).withColumns(keys), [BY_NAME[name]])


def events(df, name):
    rows = folds.tool_events(effects_of(df, name), [BY_NAME[name]]).orderBy("line_no", "step").collect()
    out = {}
    for r in rows:
        out.setdefault(r["exec_id"], []).append(r["event"])
    return out


def test_totals_line_resets_counters(log, small_blocks):
    words = ["a: error CS1: x", "b: warning CS2: y", "3 Error(s) 1 Warning(s)", "0 Error(s) 0 Warning(s)", "z"]
    logs = random_logs(words, 6)
    logs["spec"] = ["a(1,2): error CS1: m [p]", "2 Error(s) 1 Warning(s)", "b(1,2): error CS1: m [p]"]
    result = fold(log(logs), "dotnet")
    for k, v in logs.items():
        assert (result[k]["errors"], result[k]["warnings"]) == brute.dotnet(v)
    assert result["spec"]["event_count"] == 2
    assert events(log(logs), "dotnet")["spec"][0] == "✗ a:1 - m"


def test_mixed_event_cap(log, small_blocks):
    logs = random_logs(["> Task :compileX", "e: bad", "> Task :clean", "> Task :assemble error: y"], 7)
    result = fold(log(logs), "gradle")
    listed = events(log(logs), "gradle")
    for k, v in logs.items():
        assert listed.get(k, []) == brute.gradle_events(v)
        assert result[k]["event_count"] == len(brute.gradle_events(v))


def test_status_may_be_overwritten(log, small_blocks):
    ok = "test result: ok. 3 passed; 0 failed; 0 ignored; 0 measured; 0 filtered out; finished in 0.1s"
    bad = ok.replace("ok.", "FAILED.")
    logs = random_logs(["error: x", ok, bad, "y"], 8)
    result = fold(log(logs), "cargo")
    for k, v in logs.items():
        assert result[k]["status"] == brute.cargo_status(v)


@pytest.mark.parametrize("name,separator,head", [
    ("typescript", " | ", "✗ Type checking failed: "), ("git", ", ", "Git status summary: "),
])
def test_texts_with_all_events_are_parts_of_any_number(log, small_blocks, name, separator, head):
    line = {"typescript": "src/{}.ts: error TS1", "git": "modified: {}"}[name]
    mark = {"typescript": "✗ ", "git": "☑ "}[name]
    logs = {f"n{n}": [line.format(i) for i in range(n)] + ["end"] for n in (0, 1, 2, 30, 1200)}
    df = log(logs)
    verdict = folds.fold_as(df, BY_NAME[name], argument="status")
    rows = {r["exec_id"]: r for r in verdict.collect()}
    listed = folds.tool_events(effects_of(df, name), [BY_NAME[name]])
    texts_of = {}
    for r in folds.event_parts(verdict, listed, rows_per_part=7).orderBy("part_no").collect():
        texts_of[r["exec_id"]] = texts_of.get(r["exec_id"], "") + r["text"]
    for k, v in logs.items():
        want = [mark + x for x in v[:-1]]
        assert rows[k]["event_count"] == len(want)
        assert texts_of.get(k) == (head + separator.join(want) if want else None)
        assert (rows[k]["separator"] is None) == (not want)


def test_event_list_order_over_blocks(log, small_blocks):
    logs = {"e": [f"info {i}" for i in range(25)]}
    assert events(log(logs), "dart")["e"] == logs["e"]


def test_number_rows_by_nested_slices(spark):
    data = [(k, a, b) for k in range(3) for a in range(4) for b in range(5)]
    df = spark.createDataFrame(data, "key int, a int, b int")
    out = number_rows(df, "key", [F.floor(F.col("a") / 2), F.struct("a")], ["a", "b"], "n")
    for row in out.collect():
        assert row["n"] == row["a"] * 5 + row["b"]
