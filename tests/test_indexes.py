"""Rule index, path keys, history numbers and the history index against plain versions."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runsift.operators import detect, history, reduce, rootcause, rules as rules_of, suggest
from tests import brute


def test_rules_in_a_table_give_what_compiled_rules_give(spark):
    dice = random.Random(1)
    words = ["error", "disk", "FULL", "port", "in use", "lock", "ſtale", "k8s", "oom", "a.b", "Ünit"]
    kinds = ["", "panic", "warning"]

    def pattern():
        word = lambda: dice.choice(words)
        return dice.choice([
            lambda: f"(?i){word()}", lambda: f"(?i){word()}|{word()} {word()}", lambda: word(), lambda: f"(?i)({word()}|{word()})",
            lambda: f"(?i){word()}\\s+{word()}", lambda: f"(?i)x?{word()}[0-9]*{word()}", lambda: "(?i)o+m", lambda: f"^{word()}$",
            lambda: f"(?i){word()}.*{word()}", lambda: r"\p{L}{12}", lambda: f"(?ix) {word()} ",
        ])()

    rules = tuple((dice.choice(kinds), pattern(), f"do {dice.randrange(40)}") for _ in range(120))
    causes = [(f"e{k}", " ".join(dice.choice(words) + dice.choice(["", "7", "\t"]) for _ in range(dice.randrange(1, 6))), dice.choice(["panic", "WARNING", "x"])) for k in range(80)]
    causes += [("none", "", "panic"), ("tiny", "ab", "panic")]
    intel = spark.createDataFrame(causes, "exec_id string, root_cause string, error_type string")
    table = spark.createDataFrame([(i, k, p, s) for i, (k, p, s) in enumerate(rules)], "rule_ix int, error_type string, pattern string, suggestion string")
    compiled = sorted(map(tuple, suggest.suggest_fixes(intel, rules).collect()))
    found = suggest.suggest_fixes_by_table(intel, rules_of.rule_index(table)).select("exec_id", "suggestions").collect()
    assert sorted(map(tuple, found)) == compiled and len(compiled) > 40


def test_patterns_in_a_table_find_the_same_causes(spark, log):
    dice = random.Random(7)
    words = ["Error: x y", "ERROR  z", "warning: odd ", "Build failed:  oops ", "panic: p", "1:2  error  bad", "fine", "Exception: e", "Cannot find file 'f'", "no ERROR here"]
    lines = log({f"e{k}": dice.choices(words, k=dice.randrange(1, 9)) for k in range(40)})
    rows = lines.selectExpr("exec_id", "line_no AS idx", "line")
    columns = "pattern_ix int, priority int, error_type string, pattern string, before string, after string, trimmed boolean"
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(rootcause.ERROR_PATTERNS)], columns)
    found = rootcause.root_cause_by_table(rows, rules_of.rule_index(table))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rootcause.root_cause(rows).collect()))


def test_content_rules_in_a_table(spark, log):
    dice = random.Random(8)
    rules = [(k, f"f{k}", dice.choice(["alpha", "beta|gamma", "(?i)delta", "x+y", "^omega$", "alphabet"])) for k in range(30)]
    lines = {f"e{k}": dice.choices(["an alpha", "GAMMA", "a Delta", "xxy", "omega", "alphabet", "none"], k=3) for k in range(40)}
    table = rules_of.rule_index(spark.createDataFrame(rules, "priority int, family string, pattern string"))
    found = {r["exec_id"]: r["family"] for r in detect.detect_by_content_table(log(lines), table).collect()}
    want = {}
    for e, some in lines.items():
        hits = [p for p, _, x in rules if any(re.search(x, line) for line in some)]
        if hits:
            want[e] = f"f{min(hits)}"
    assert found == want


def test_pieces_that_a_pattern_needs():
    assert rules_of.required_pieces("(?i)Module not found|can't resolve") == ["can'", "modu"]
    assert rules_of.required_pieces("(?i)abc") == [] and rules_of.required_pieces("(?i)lock|x") == []
    assert rules_of.required_pieces("ab?cdefg") == ["cdef"] and rules_of.required_pieces("(") == []


def test_changed_files_of_any_shape_are_found(spark):
    dice = random.Random(2)
    letters = "ab/._- é漢"
    windows, files, want = [], [], {}
    for k in range(40):
        near = ["".join(dice.choice(letters) for _ in range(dice.randrange(25))) for _ in range(4)]
        paths = set()
        for line in near:
            for _ in range(3):
                a, b = sorted((dice.randrange(len(line) + 1), dice.randrange(len(line) + 1)))
                paths |= {line[a:b], line[a:b] + "x"}
        paths |= {"a/", "/", "src/very-long-name.component.ts"}
        paths.discard("")
        cause = None if k % 9 == 0 else "c"
        windows.append((f"e{k}", cause, near))
        files += [(f"e{k}", p) for p in paths] * 2
        found = sorted(p for p in paths if any(p in line for line in near))
        if cause and found:
            want[f"e{k}"] = found
    w = spark.createDataFrame(windows, "exec_id string, cause string, _near array<string>")
    f = spark.createDataFrame(files, "exec_id string, path string")
    rows = {r["exec_id"]: sorted(r["correlated_changes"]) for r in rootcause.correlate_changes(w, f).collect()}
    assert rows == want


def entries(spark, n, seed):
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcÉ") for _ in range(dice.randrange(1, 6)))
    rows = [(f"{dice.randrange(10**6):06d}-{k}", " ".join(word() for _ in range(3)), dice.choice(["success", "failure"]), word() if k % 7 else None, f"2024-01-01 00:00:{dice.randrange(3):02d}") for k in range(n)]
    return spark.createDataFrame(rows, "execution_id string, command string, status string, summary string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_history_numbers(spark):
    df = entries(spark, 500, 3).repartition(5)
    rows = history.history_list(df).collect()
    in_order = sorted(rows, key=lambda r: (r["ts"], r["execution_id"]))
    assert [r["entry_no"] for r in in_order] == list(range(1, 501))
    assert history.history_list(df.limit(0)).count() == 0


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    df = entries(spark, 400, 4)
    index = history.build_history_index(df, str(tmp_path / "index"), block_rows=16)
    dice = random.Random(5)
    queries = ["", "  ", "a", "ab", "FAIL", "success nothing", "zzz", "no such words"]
    queries += [" ".join("".join(dice.choice("abcé") for _ in range(dice.randrange(2, 6))) for _ in range(dice.randrange(1, 3))) for _ in range(12)]
    for q in queries:
        plain = sorted(map(repr, history.history_search(df, q).collect()))
        assert sorted(map(repr, index.search(q).select(df.columns).collect())) == plain, q
    assert index.candidates("zzzz").count() == 0
    rare = next(w for r in df.collect() for w in r["command"].lower().split() if len(w) == 5)
    assert 0 < index.candidates(rare).count() < 400
    few = history.HistoryIndex(spark, index.path, 3, most_blocks=1)
    assert few.search(rare).count() == index.search(rare).count()


@pytest.mark.parametrize("rows", [1, 2, 5, 1000])
def test_grouping_is_stitched_at_borders(log, rows):
    dice = random.Random(rows)
    logs = {f"e{k}": dice.choices(["ok a", "FAIL b", "✓ c", "x", "y", " ", "PASS d"], k=dice.randrange(1, 40)) for k in range(30)}
    logs["results"] = ["ok a"] * 9 + ["FAIL b"] * 4
    logs["blank"] = [" "]
    found = {}
    for r in reduce.group_pass_fail(log(logs), rows).collect():
        found.setdefault(r["exec_id"], []).append((r["idx"], r["line"]))
    want = {k: list(enumerate(brute.group_results([x.strip() for x in v if x.strip()]))) for k, v in logs.items()}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changed_files_send_no_lines(spark, tmp_path):
    """The lines near a cause stand in compressed files: small there, large once cut into pieces."""
    lines = [f"at src/file{k}.ts line {k}" for k in range(10)]
    spark.createDataFrame([(e, "c", lines) for e in range(50)], "exec_id bigint, cause string, _near array<string>").write.parquet(f"{tmp_path}/w")
    windows = spark.read.parquet(f"{tmp_path}/w")
    files = spark.createDataFrame([(1, "src/file3.ts"), (1, "x/file3.ts"), (1, "rc"), (2, "src/file9.ts"), (2, "src/file9.ts"), (99, "rc")], "exec_id bigint, path string")
    found = rootcause.correlate_changes(windows, files)
    assert {r["exec_id"]: r["correlated_changes"] for r in found.collect()} == {1: ["rc", "src/file3.ts"], 2: ["src/file9.ts"]}
    assert "Broadcast" not in plan(found)


def test_reduced_lines_are_read_once(spark):
    """Windows near a cause are made once: what is added to them reads stored rows, and finds the same."""
    logs = {
        "a": ["ok", "Error: listen EADDRINUSE", "at src/a.ts", None, "bye"],
        "b": ["Build failed: no space left", "", "lib/c.dart"],
        "c": ["all is well"],
        "d": [None, ""],
        None: ["panic: src/a.ts"],
    }
    numbered = spark.createDataFrame([(e, k, x) for e, some in logs.items() for k, x in enumerate(some) for _ in range(1 + (e == "b"))], "exec_id string, idx bigint, line string")
    by_line = Window.partitionBy("exec_id").orderBy("idx", "line")
    rows = numbered.withColumn("idx", (F.row_number().over(by_line) - 1).cast("bigint"))
    files = spark.createDataFrame([("a", "src/a.ts"), ("a", "src/a.ts"), ("a", None), ("a", ""), ("b", "lib/c.dart"), ("b", "x"), (None, "src/a.ts"), ("z", "ok")], "exec_id string, path string")
    intel = rootcause.error_intel(rows, files)
    assert "Window" not in plan(intel)
    want = rootcause.with_changes(rootcause.cause_windows(rows), files)
    assert intel.columns == want.columns
    assert sorted(map(repr, intel.collect())) == sorted(map(repr, want.collect()))
    assert {r["exec_id"]: r["correlated_changes"] for r in intel.collect()} == {"a": ["", "src/a.ts"], "b": ["lib/c.dart"], None: []}
    assert rootcause.error_intel(rows.limit(0), files).count() == 0


def test_texts_and_rules_are_prepared_once(spark):
    """Python sees a rule once, and a text is not put in lower case again for each of its places."""
    texts = spark.createDataFrame([(1, "Disk FULL"), (1, "Disk FULL"), (2, None), (3, ""), (None, "disk full now"), (4, "a ſtale lock"), (5, "no")], "exec_id int, line string")
    table = spark.createDataFrame([(0, "(?i)disk full"), (0, "(?i)disk full"), (1, None), (2, "(?i)stale|lock"), (3, "(?i)x?no"), (4, "FULL")], "ix int, pattern string")
    index = rules_of.rule_index(table)
    assert index.columns == ["ix", "pattern", "java_pattern", "piece"]
    assert sorted((r["ix"], r["piece"]) for r in index.collect()) == [(0, "disk"), (0, "disk"), (1, ""), (2, "lock"), (2, "stal"), (3, ""), (4, "full")]
    found = rules_of.matching(texts, "line", index)
    want = [(1, "Disk FULL", k) for k in (0, 1, 4)] + [(3, "", 1)] + [(None, "disk full now", k) for k in (0, 1, 3)]
    want += [(4, "a ſtale lock", k) for k in (1, 2)] + [(5, "no", k) for k in (1, 3)]
    assert found.columns == ["exec_id", "line", "ix"]
    rows = list(map(tuple, found.collect()))
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    nodes = plan(found)
    assert nodes.count("BatchEvalPython") == 1
    assert [line for line in nodes.splitlines() if "explode(" in line and "lower(" in line] == []
