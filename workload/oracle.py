"""The registered queries as plain SQL over the same tables.

Written independently of the library: per-execution windows and text functions, no blocks.
"""

from __future__ import annotations

from workload import templates
from workload.queries import FORCED, FORCED_ARGUMENT, SEARCHES

# Patterns in RE2 spelling and the white-space class.
WS = (
    r"\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
ANSI = (
    r"[\x1B\x{9B}][[\]()#;?]*(?:(?:(?:[a-zA-Z\d]*(?:;[a-zA-Z\d]*)*)?\x07)"
    r"|(?:(?:\d{1,4}(?:;\d{0,4})*)?[\dA-PRZcf-ntqry=><~]))"
)
TS = r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[\.,]\d{3}Z?\s*"
CHAIN = r"\s*(?:&&|;|\|\||\|)\s*"
PASS = r"^(?i)(?:\x{2713}|PASS|ok)\s+(.*)"
FAIL = r"^(?i)(?:\x{2717}|FAIL)\s+(.*)"
MARKER = "... [TRUNCATED: LOG TOO LONG] ..."


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def cap(x: str, pattern: str, group: int = 1) -> str:
    return f"CASE WHEN {rx(x, pattern)} THEN regexp_extract({x}, {q(pattern)}, {group}) END"


def num(x: str, pattern: str, group: int = 1) -> str:
    return f"CAST({cap(x, pattern, group)} AS BIGINT)"


def has(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def starts(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(w)})" for w in words) + ")"


def ends(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {q(w)})" for w in words) + ")"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------- views

TPL = "tpl(tool_ix, k, line) AS (VALUES " + ", ".join(
    f"({ix}, {k}, {q(line)})" for ix, _, lines in templates.tools() for k, line in enumerate(lines)
) + ")"
CMD = "cmds(tool_ix, command) AS (VALUES " + ", ".join(
    f"({ix}, {q(c)})" for ix, c, _ in templates.tools()
) + ")"
EVENT_LINES = """event_lines AS (
  SELECT e.user_id AS exec_id, e.event_id, t.line
  FROM events e JOIN tpl t ON t.tool_ix = e.user_id % 25
   AND t.k = CASE WHEN (e.user_id // 25) % 2 = 0
     THEN CASE WHEN (e.event_id * 7 + e.user_id) % 12 < 6 THEN (e.event_id * 7 + e.user_id) % 3
               ELSE 6 + (e.event_id * 7 + e.user_id) % 4 END
     ELSE (e.event_id * 7 + e.user_id) % 12 END)"""
LOG_LINES = """log_lines AS (
  SELECT exec_id, row_number() OVER (PARTITION BY exec_id ORDER BY event_id) - 1 AS line_no, line
  FROM event_lines)"""
LOGS = [TPL, EVENT_LINES, LOG_LINES]
DOC_LINES = """doc_lines AS (
  SELECT exec_id, pos - 1 AS line_no, parts[pos] AS line FROM (
    SELECT doc_id AS exec_id, string_split(text, chr(10)) AS parts,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
    FROM documents))"""
EXECUTIONS = r"""executions AS (
  SELECT exec_id, command_line, regexp_extract_all(command_line, '\S+') AS tokens,
         CASE WHEN (exec_id // 25) % 2 = 1 AND exec_id % 2 = 0 THEN 1 ELSE 0 END AS exit_code,
         start_ts, end_ts
  FROM (SELECT u.exec_id, u.start_ts, u.end_ts,
               CASE u.exec_id % 10 WHEN 8 THEN 'cd app && ' || c.command WHEN 9 THEN 'sh ci.sh'
                    WHEN 7 THEN c.command || ' | tee out.log' ELSE c.command END AS command_line
        FROM (SELECT user_id AS exec_id, min(ts) AS start_ts, max(ts) AS end_ts
              FROM events GROUP BY user_id) u JOIN cmds c ON c.tool_ix = u.exec_id % 25))"""
EXECS = [CMD, EXECUTIONS]
PASTED = f"""pasted AS (
  SELECT doc_id::VARCHAR AS exec_id, p.prefix || replace(text, chr(10), chr(10) || p.prefix) AS text
  FROM documents JOIN (VALUES {", ".join(f"({ix}, {q(lines[0] + ' ')})" for ix, _, lines in templates.tools())})
    p(ix, prefix) ON p.ix = doc_id % 25)"""
PASTED_LINES = """pasted_lines AS (
  SELECT exec_id, pos - 1 AS line_no, parts[pos] AS line FROM (
    SELECT exec_id, string_split(text, chr(10)) AS parts,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
    FROM pasted))"""
CHANGED = f"""changed AS (
  SELECT u.exec_id, p.path FROM (SELECT DISTINCT user_id AS exec_id FROM events) u
  JOIN (VALUES {", ".join(f"({i}, {q(p)})" for i, p in enumerate(templates.CHANGED_PATHS))})
    p(ix, path) ON p.ix <> u.exec_id % 4)"""
HISTORY = """history AS (
  SELECT o_orderkey::VARCHAR AS execution_id, c.command,
         CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS status,
         o_orderpriority AS summary, o_orderdate AS ts, o_orderkey
  FROM orders JOIN cmds c ON c.tool_ix = o_custkey % 25)"""
COMMANDS = f"""commands AS (
  SELECT DISTINCT {trim("command")} AS command FROM (
    SELECT command FROM history
    UNION ALL SELECT command || ' && git push ; ' || command FROM history
    UNION ALL SELECT upper(command) || ' || echo done' FROM history
    UNION ALL SELECT x FROM (VALUES {", ".join(f"({q(c)})" for c in templates.EXTRA_COMMANDS)}) t(x)))"""
HIST = [CMD, HISTORY]

# ---------------------------------------------------------------- cleaning and reduction


def clean(source: str = "log_lines") -> list[str]:
    normal = trim(f"regexp_replace(regexp_replace(line, {q(ANSI)}, '', 'g'), {q(TS)}, '')")
    return [
        f"normal AS (SELECT exec_id, line_no, {normal} AS line FROM {source})",
        """marked AS (SELECT *, lag(line) OVER (PARTITION BY exec_id ORDER BY line_no) AS prev
  FROM normal WHERE line <> '')""",
        f"""clean AS (SELECT exec_id, line_no, line FROM marked
  WHERE line IS DISTINCT FROM prev AND NOT {starts("line", "Downloading ", "Progress: ")})""",
    ]


def rle(source: str = "clean") -> list[str]:
    return [
        f"""r0 AS (SELECT exec_id, line_no, line,
    CASE WHEN lag(line) OVER w IS DISTINCT FROM line THEN 1 ELSE 0 END AS s
  FROM {source} WINDOW w AS (PARTITION BY exec_id ORDER BY line_no))""",
        "r1 AS (SELECT *, sum(s) OVER (PARTITION BY exec_id ORDER BY line_no) AS isl FROM r0)",
        """rle AS (SELECT exec_id, CAST(isl - 1 AS BIGINT) AS idx,
    CASE WHEN count(*) > 1 THEN min(line) || ' (Repeated ' || count(*) || ' times)'
         ELSE min(line) END AS line
  FROM r1 GROUP BY exec_id, isl)""",
    ]


def truncate(source: str = "rle") -> list[str]:
    return [
        f"t0 AS (SELECT *, count(*) OVER (PARTITION BY exec_id) AS n FROM {source})",
        f"""trunc AS (
  SELECT exec_id, idx, line FROM t0 WHERE n <= 800 OR idx < 300
  UNION ALL SELECT exec_id, 300, {q(MARKER)} FROM t0 WHERE n > 800 AND idx = 299
  UNION ALL SELECT exec_id, idx - (n - 500) + 301, line FROM t0 WHERE n > 800 AND idx >= n - 500)""",
    ]


NOISE = (
    f"(({has('lower(line)', 'node_modules')} AND {has('lower(line)', 'warning')}) OR "
    f"{starts('lower(line)', '[info] downloading', '[info] fetching')})"
)


def grouped(source: str, order: str) -> list[str]:
    return [
        f"""g0 AS (SELECT exec_id, {order} AS ord, line, {rx("line", PASS)} AS p,
    NOT {rx("line", PASS)} AND {rx("line", FAIL)} AS f FROM {source})""",
        """g1 AS (SELECT *, coalesce(sum(CASE WHEN p OR f THEN 0 ELSE 1 END) OVER (
    PARTITION BY exec_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM g0)""",
        """g2 AS (SELECT exec_id, seg, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE f) AS nf,
    max(line) FILTER (WHERE NOT p AND NOT f) AS rest FROM g1 GROUP BY exec_id, seg)""",
        """g3 AS (
  SELECT exec_id, seg, 0 AS k, '✓ ' || np || ' tests passed' AS line FROM g2 WHERE np > 0
  UNION ALL SELECT exec_id, seg, 1, '✗ ' || nf || ' tests failed' FROM g2 WHERE nf > 0
  UNION ALL SELECT exec_id, seg, 2, rest FROM g2 WHERE rest IS NOT NULL)""",
        """grouped AS (SELECT exec_id,
    row_number() OVER (PARTITION BY exec_id ORDER BY seg, k) - 1 AS idx, line FROM g3)""",
    ]


def reduced() -> list[str]:
    return [
        *rle(),
        *truncate(),
        f"""o1 AS (SELECT *, lag(line) OVER (PARTITION BY exec_id ORDER BY idx) AS before
  FROM trunc WHERE NOT {NOISE})""",
        "o2 AS (SELECT exec_id, idx, line FROM o1 WHERE line IS DISTINCT FROM before)",
        *grouped("o2", "idx"),
        "reduced AS (SELECT * FROM grouped)",
    ]


# ---------------------------------------------------------------- detection

# Command and content rules by precedence (c = sub-command, a1/a2 = arguments).
BUNDLERS = ("webpack", "rollup", "esbuild", "next", "nuxt", "turbopack")
SIGNS = ("webpack", "rollup", "esbuild", "next.js", "nuxt", "compiled successfully")
FORMATTERS = ("prettier", "stylelint")
MIGRATORS = ("prisma", "migrate", "sequelize", "drizzle", "alembic", "knex")
RUN = "c = 'npm' AND a1 = 'run' AND "
RULES = {
    "vitest": (
        f"(c IN ('vitest', 'jest') OR ({RUN} a2 = 'test'))",
        has("line", "vitest", "Test Files", "PASS ", "FAIL "),
    ),
    "jest": (ends("c", "jest"), has("line", "jest", "FAIL", "PASS", "Test Suites:")),
    "playwright": (has("c", "playwright"), None),
    "cypress": (has("c", "cypress"), has("line", "cypress", "Run Finished", "Tests Results:")),
    "pytest": (
        f"({ends('c', 'pytest')} OR (c = 'python' AND a1 = '-m' AND a2 = 'pytest'))",
        f"({has('line', 'test session starts', 'pytest')} OR "
        f"({has('line', '===')} AND {has('line', 'passed in')}))",
    ),
    "go test": (
        "(c = 'go' AND a1 = 'test')",
        starts("line", "--- PASS:", "--- FAIL:", "ok\t", "FAIL\t"),
    ),
    "flutter_test": (
        "(c = 'flutter' AND a1 = 'test')",
        f"({has('line', 'All tests passed!', 'Some tests failed')} OR "
        f"({has('line', 'Shell:')} AND {has('line', 'test')}))",
    ),
    "typescript": (ends("c", "tsc"), None),
    "dart": ("(c = 'dart' AND a1 = 'analyze')", None),
    "vite": (
        f"(c = 'vite' OR ({RUN} a2 IN ('build', 'dev')))",
        f"({has('line', '[vite]')} OR {has('lower(line)', 'vite v')})",
    ),
    "buildtool": (has("c", *BUNDLERS), has("lower(line)", *SIGNS)),
    "eslint": (
        f"(c = 'eslint' OR ({RUN} {has('a2', 'lint')}))",
        f"({has('line', 'eslint')} OR ({has('line', 'error')} AND {has('line', 'warning')} AND "
        f"{has('line', ':')}))",
    ),
    "linter": (has("c", *FORMATTERS), None),
    "golangci-lint": (ends("c", "golangci-lint"), None),
    "flutter_build": ("(c = 'flutter' AND a1 = 'build')", None),
    "flutter_run": ("(c = 'flutter' AND a1 = 'run')", None),
    "gradle": (has("c", "gradle"), None),
    "dotnet": (f"({has('c', 'dotnet', 'msbuild')} OR {ends('c', 'nuget')})", None),
    "dbmigrate": (has("c", *MIGRATORS), None),
    "npm": (ends("c", "npm"), f"({has('lower(line)', 'npm error')} OR {has('line', 'npm ERR!')})"),
    "pnpm": (ends("c", "pnpm"), None),
    "yarn": (ends("c", "yarn"), None),
    "cargo": (ends("c", "cargo"), None),
    "git": (ends("c", "git", "git.exe"), None),
}
KEYWORDS = {
    "buildtool": (BUNDLERS, SIGNS),
    "linter": (FORMATTERS, ()),
    "dbmigrate": (MIGRATORS, ()),
}
EXTENDED = ("flutter_build", "flutter_test", "vite", "vitest", *RULES)


def first_word(x: str, words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def tool_name(x: str, side: int) -> str:
    cases = [
        f"WHEN family = {q(f)} THEN {first_word(x, words[side])}"
        for f, words in KEYWORDS.items()
        if words[side]
    ]
    return "CASE " + " ".join(cases) + " ELSE family END"


def by_command(order=tuple(RULES), source: str = "executions") -> list[str]:
    rules = " ".join(f"WHEN {RULES[f][0]} THEN {q(f)}" for f in order)
    return [
        f"""chain AS (SELECT exec_id, parts[pos] AS part, pos FROM (
    SELECT exec_id, parts, unnest(generate_series(1, len(parts))) AS pos FROM (
      SELECT exec_id, regexp_split_to_array(command_line, {q(CHAIN)}) AS parts FROM {source})))""",
        f"""parts AS (SELECT exec_id, row_number() OVER (PARTITION BY exec_id ORDER BY pos) - 1 AS part_no,
    part FROM (SELECT exec_id, pos, {trim("part")} AS part FROM chain) WHERE part <> '')""",
        f"tokens AS (SELECT *, regexp_extract_all(part, '[^{WS}]+') AS w FROM parts)",
        """words AS (SELECT exec_id, part_no, w[1] AS c, coalesce(w[2], '') AS a1,
    coalesce(w[3], '') AS a2 FROM tokens)""",
        f"claims AS (SELECT *, CASE {rules} END AS family FROM words)",
        """last_claim AS (SELECT exec_id, arg_max(c, part_no) AS c, arg_max(a1, part_no) AS argument,
    arg_max(family, part_no) AS family FROM claims WHERE family IS NOT NULL GROUP BY exec_id)""",
        f"""by_command AS (SELECT e.exec_id, CASE WHEN l.family IS NOT NULL THEN {tool_name("c", 0)} END AS tool,
    l.family, l.argument FROM {source} e LEFT JOIN last_claim l USING (exec_id))""",
    ]


def by_content(order=tuple(RULES)) -> list[str]:
    rules = " ".join(
        f"WHEN {RULES[f][1]} THEN {i}" for i, f in enumerate(order) if RULES[f][1]
    )
    names = " ".join(f"WHEN {i} THEN {q(f)}" for i, f in enumerate(order) if RULES[f][1])
    return [
        """samples AS (SELECT exec_id, line_no, line FROM (
    SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY line_no) AS rn FROM clean)
  WHERE rn <= 10)""",
        f"scored AS (SELECT *, CASE {rules} END AS prio FROM samples)",
        """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY exec_id ORDER BY prio, line_no) AS rn FROM scored WHERE prio IS NOT NULL)
  WHERE rn = 1)""",
        f"""by_content AS (SELECT exec_id, {tool_name("lower(line)", 1)} AS tool, family FROM (
    SELECT exec_id, line, CASE prio {names} END AS family FROM firsts))""",
    ]


def tools(order=tuple(RULES), source: str = "executions") -> list[str]:
    return [
        *by_command(order, source),
        *by_content(order),
        """tools AS (SELECT b.exec_id, coalesce(b.tool, n.tool, 'fallback') AS tool,
    coalesce(b.family, n.family, 'fallback') AS family, coalesce(b.argument, '') AS argument
  FROM by_command b LEFT JOIN by_content n USING (exec_id))""",
    ]


# ---------------------------------------------------------------- folds

L = "lower(line)"
VITE_SIGN = rx("line", r"(?i)(?:ERROR|FAILED|Build failed)")
TSC = r"(.*?)\((\d+),(\d+)\): error (TS\d+): (.*)"
NET = r"(.*?)\((\d+),(\d+)\): error (CS\d+): (.*) \[(.*)\]"
PYT = r"={2,}\s+(.*?)\s+in\s+([\d\.]+)s\s+={2,}"
CARGO = (
    r"test result: (ok|FAILED)\. (\d+) passed; (\d+) failed; (\d+) ignored; (\d+) measured; "
    r"(\d+) filtered out; finished in ([\d\.]+)s"
)
STAT = r"(\d+) files? changed, (\d+) insertions?\(\+\), (\d+) deletions?\(-\)"


def located(pattern: str) -> str:
    parts = " || ".join(
        [f"regexp_extract(line, {q(pattern)}, 1)", "':'", f"regexp_extract(line, {q(pattern)}, 2)"]
    )
    return (
        f"CASE WHEN {rx('line', pattern)} THEN '✗ ' || {parts} || ' - ' || "
        f"regexp_extract(line, {q(pattern)}, 5) ELSE '✗ ' || line END"
    )


def outcome(test: str) -> str:
    """Leading number of the last comma part for which `test` (over p) holds."""
    parts = f"list_filter(string_split({cap('line', PYT)}, ','), lambda p: {test})"
    return f"TRY_CAST(regexp_extract({trim(f'({parts})[-1]')}, '^[^{WS}]+') AS BIGINT)"


# The patterns, words and texts of the rules below.
def fold_rules() -> dict[str, dict[str, str]]:
    """Per family: SQL of its line effects, verdict text `text` and extra failure `bad`."""
    red_vitest = f"({has('line', 'FAIL', 'failed')} AND {starts('line', 'FAIL ', '✗ ')})"
    vt_failed = f"coalesce({num('line', r'(\d+)\s+failing')}, {num('line', r'Tests\s+(\d+)\s+failed')})"
    jest = r"Tests:\s+(\d+) failed,\s+(\d+) passed,\s+(\d+) total"
    play = r"(\d+) passed.*\(.*\)\s+(\d+) failed"
    cy = has("line", " (failed)", " ✖ ")
    sect = has("line", "FAILURES", "ERRORS")
    every, some = r"\+(\d+):\s*All tests passed!", r"\+(\d+)\s*-(\d+):\s*Some tests failed"
    vite_err = f"({VITE_SIGN} AND NOT {has(L, '0 failed', 'operation succeeded')})"
    es = (
        f"(({has('line', ' error ')} OR {starts('line', 'error ')}) AND NOT "
        f"{rx('line', r'0\s+errors?')})"
    )
    low_err = has(L, "error", "failed")
    go = {
        "tf": has("line", "--- FAIL:"),
        "tp": has("line", "--- PASS:"),
        "sf": starts("line", "FAIL\t"),
        "sp": starts("line", "ok\t", "PASS"),
        "be": has("line", "build failed", "build errors"),
    }
    go_state = (
        f"CASE WHEN {go['tf']} THEN 'tf' WHEN {go['tp']} THEN 'tp' WHEN {go['sf']} THEN 'sf' "
        f"WHEN {go['sp']} THEN 'sp' WHEN {go['be']} THEN 'be' END"
    )
    run_err = (
        f"(NOT {has('line', 'Running with unset MSYS', 'Launching')} AND "
        f"{has('line', 'Error', 'Exception')})"
    )
    golint = f"({has('line', ':')} AND {has('line', 'errcheck', 'unused', 'staticcheck')})"
    npm_err = f"({has('line', 'ERR!')} OR {has(L, 'npm error')})"
    cargo_err = has("line", "error:", "error[")
    cargo_ok = f"({starts('line', 'test result:')} AND {rx('line', CARGO)})"
    mig_done = has(L, "migrated", "migration successfully")
    mig_run = has("line", "Applying migration", "Running migration")
    net_err = has("line", ": error CS")
    net_sum = r"(\d+) Error\(s\).*?(\d+) Warning\(s\)"
    task = r"^> Task :(.*)"
    tests = (
        "CASE WHEN failed > 0 THEN {bad} WHEN passed > 0 THEN {good} ELSE {none} END"
    )
    either = "CASE WHEN failure THEN {bad} ELSE {good} END"

    def sticky(condition: str) -> str:
        return f"CASE WHEN {condition} THEN 1 END"

    def ladder(bad: str, good: str, none: str) -> str:
        return tests.format(bad=bad, good=good, none=q(none))

    def two(bad: str, good: str) -> str:
        return either.format(bad=bad, good=good)

    return {
        "vitest": {
            "fails": sticky(f"{red_vitest} OR ({vt_failed}) IS NOT NULL"),
            "files": num("line", r"Test Files\s+(\d+)\s+passed"),
            "set_passed": f"coalesce({num('line', r'(\d+)\s+passing')}, {num('line', r'Tests\s+(\d+)\s+passed')})",
            "set_failed": vt_failed,
            "event": f"CASE WHEN {red_vitest} THEN line END",
            "bad": "failed > 0",
            "text": ladder("'✗ ' || failed || ' tests failed'", "'✓ ' || passed || ' tests passed'", "Test execution completed"),
        },
        "jest": {
            "fails": sticky(f"{has('line', ' FAIL ')} OR coalesce({num('line', jest)}, 0) > 0"),
            "set_failed": num("line", jest, 1),
            "set_passed": num("line", jest, 2),
            "event": f"CASE WHEN {has('line', ' FAIL ')} THEN '✗ ' || line END",
            "bad": "failed > 0",
            "text": ladder("'✗ Jest failed: ' || failed || ' failed'", "'✓ Jest passed: ' || passed || ' passed'", "Jest execution completed."),
        },
        "playwright": {
            "fails": sticky(has("line", " Error: ")),
            "errors": has("line", " Error: "),
            "set_passed": num("line", play, 1),
            "set_failed": num("line", play, 2),
            "event": f"CASE WHEN {has('line', ' Error: ')} THEN '✗ ' || line END",
            "bad": "failed > 0",
            "text": ladder("'✗ Playwright failed: ' || failed || ' failed'", "'✓ Playwright passed: ' || passed || ' passed'", "Playwright execution completed."),
        },
        "cypress": {
            "fails": sticky(cy),
            "failed": cy,
            "passed": f"NOT {cy} AND {has('line', ' (passed)', ' ✔ ')}",
            "event": f"CASE WHEN {cy} THEN '✗ ' || line END",
            "bad": "failed > 0",
            "text": ladder("'✗ Cypress failed: ' || failed || ' failing'", "'✓ Cypress passed: ' || passed || ' passing'", "Cypress execution completed"),
        },
        "pytest": {
            "fails": sticky(f"{sect} OR ({outcome('NOT contains(p, ' + q('passed') + ') AND contains(p, ' + q('failed') + ')')}) IS NOT NULL"),
            "errors": f"NOT {sect} AND {starts('line', 'E   ')}",
            "set_passed": outcome("contains(p, 'passed')"),
            "set_failed": outcome("NOT contains(p, 'passed') AND contains(p, 'failed')"),
            "set_warnings": outcome("NOT contains(p, 'passed') AND NOT contains(p, 'failed') AND contains(p, 'warning')"),
            "duration": f"CASE WHEN {rx('line', PYT)} THEN coalesce(TRY_CAST(regexp_extract(line, {q(PYT)}, 2) AS DOUBLE), 0) END",
            "event": f"CASE WHEN {sect} THEN 'Found failures/errors section' WHEN {starts('line', 'E   ')} THEN line END",
            "bad": "failed > 0 OR errors > 0",
            "text": "CASE WHEN failed > 0 OR errors > 0 THEN '✗ Pytest failed: ' || failed || ' failed' WHEN passed > 0 THEN '✓ Pytest passed: ' || passed || ' passed' ELSE 'Pytest execution completed.' END",
        },
        "go test": {
            "fails": sticky(f"({go_state}) IN ('tf', 'sf', 'be')"),
            "failed": f"({go_state}) = 'tf'",
            "passed": f"({go_state}) = 'tp'",
            "errors": f"({go_state}) = 'be'",
            "event": f"CASE {go_state} WHEN 'tf' THEN line WHEN 'sf' THEN 'Test suite failed: ' || line WHEN 'sp' THEN 'Test suite passed: ' || line WHEN 'be' THEN 'Build error: ' || line END",
            "bad": "failed > 0 OR errors > 0",
            "text": two("'✗ Go Tests Failed. Passed: ' || passed || ', Failed: ' || failed", "'✓ Go Tests Passed. Passed: ' || passed"),
        },
        "flutter_test": {
            "fails": sticky(f"{has('line', 'EXCEPTION: ', 'Exception: ')} OR (NOT {rx('line', every)} AND {rx('line', some)})"),
            "set_passed": f"coalesce({num('line', every)}, {num('line', some)})",
            "set_failed": f"CASE WHEN NOT {rx('line', every)} THEN {num('line', some, 2)} END",
            "event": f"CASE WHEN {has('line', 'EXCEPTION: ', 'Exception: ')} THEN line END",
            "bad": "failed > 0",
            "text": ladder("'✗ ' || failed || ' tests failed'", "'✓ ' || passed || ' tests passed'", "Flutter test completed"),
        },
        "typescript": {
            "fails": sticky(f"{has('line', ': error TS')} OR ({has('line', 'Found')} AND {has('line', 'error')})"),
            "errors": has("line", ": error TS"),
            "event": f"CASE WHEN {has('line', ': error TS')} THEN {located(TSC)} END",
            "text": "CASE WHEN errors > 0 THEN '✗ Type checking failed: ' ELSE '✓ Type checking passed' END",
            "separator": "CASE WHEN errors > 0 THEN ' | ' ELSE '' END",
        },
        "dart": {
            "fails": sticky(starts("line", "error ")),
            "errors": starts("line", "error "),
            "warnings": starts("line", "warning "),
            "event": f"CASE WHEN {starts('line', 'info ', 'error ', 'warning ')} THEN line END",
            "text": "CASE WHEN errors > 0 THEN '✗ Dart analyze failed with error' WHEN warnings > 0 THEN '⚠ Dart analyze found warnings' ELSE '✓ Dart analyze passed' END",
        },
        "vite": {
            "fails": sticky(vite_err),
            "errors": vite_err,
            "warnings": f"NOT {VITE_SIGN} AND {has(L, 'warn')}",
            "modules": num("line", r".*?\s*(\d+)\s+modules\s+(?:transformed|compiled)"),
            "bundle": cap("line", r"dist/.*?(\d+\.\d+\s*[KMG]B)"),
            "event": f"CASE WHEN {vite_err} THEN line END",
            "cap": "5",
            "text": "CASE WHEN bundle <> '' THEN '✓ Build completed. Output: ' || bundle || CASE WHEN failure THEN ' (with non-fatal errors detected)' ELSE '' END WHEN modules > 0 THEN '✓ Build succeeded. ' || modules || ' modules compiled' WHEN failure THEN '✗ Vite build failed' ELSE '✓ Operation succeeded' END",
        },
        "buildtool": {
            "fails": f"CASE WHEN {low_err} THEN 1 WHEN {has(L, 'compiled successfully', 'build successful')} THEN 0 END",
            "errors": low_err,
            "event": f"CASE WHEN {low_err} THEN '✗ ' || line END",
            "cap": "5",
            "text": two("'✗ ' || tool || ' build failed'", "'✓ ' || tool || ' build successful'"),
        },
        "eslint": {
            "fails": sticky(es),
            "errors": es,
            "warnings": f"NOT {es} AND ({has('line', ' warning ')} OR {starts('line', 'warning ')})",
            "event": f"CASE WHEN {es} THEN line END",
            "text": "CASE WHEN errors = 0 AND warnings = 0 THEN '✓ No lint errors' ELSE concat_ws(chr(10), CASE WHEN errors > 0 THEN '✗ ' || errors || ' error' || CASE WHEN errors > 1 THEN 's' ELSE '' END END, CASE WHEN warnings > 0 THEN '⚠ ' || warnings || ' warning' || CASE WHEN warnings > 1 THEN 's' ELSE '' END END) END",
        },
        "linter": {
            "fails": sticky(low_err),
            "errors": low_err,
            "event": f"CASE WHEN {low_err} THEN '⚠ ' || line END",
            "cap": "5",
            "text": "CASE WHEN errors > 0 THEN '✗ ' || tool || ' found issues' ELSE '✓ ' || tool || ' passed' END",
        },
        "golangci-lint": {
            "fails": sticky(golint),
            "errors": golint,
            "event": f"CASE WHEN {golint} THEN '⚠ ' || line END",
            "cap": "5",
            "text": "CASE WHEN errors > 0 THEN '✗ golangci-lint found issues' ELSE '✓ golangci-lint passed' END",
        },
        "flutter_build": {
            "fails": sticky(has("line", "Exception: ", "Error:")),
            "artifact": cap("line", r"Built\s+.*?\s+\((.*?)\)\."),
            "event": f"CASE WHEN {has('line', 'Exception: ', 'Error:')} THEN line END",
            "text": "CASE WHEN failure THEN '✗ Flutter build failed' WHEN artifact <> '' THEN '✓ Flutter build succeeded' || chr(10) || 'APK size ' || artifact ELSE '✓ Flutter build succeeded' END",
        },
        "flutter_run": {
            "fails": sticky(run_err),
            "errors": run_err,
            "event": f"CASE WHEN {run_err} THEN '✗ ' || line END",
            "text": two("'✗ Flutter run failed'", "'✓ Flutter app is running'"),
        },
        "gradle": {
            "fails": sticky(f"{starts('line', 'FAILURE: Build failed')} OR {has('line', 'FAILED', 'error:', 'e: ')}"),
            "errors": has("line", "error:", "e: "),
            "event": f"CASE WHEN {rx('line', task)} AND {has(f'regexp_extract(line, {q(task)}, 1)', 'compile', 'assemble', 'bundle')} THEN '⚙ ' || regexp_extract(line, {q(task)}, 1) END",
            "event2": f"CASE WHEN {has('line', 'error:', 'e: ')} THEN '✗ ' || line END",
            "cap2": "10",
            "text": two("'✗ Gradle build failed'", "'✓ Gradle build succeeded'"),
        },
        "dotnet": {
            "fails": sticky(net_err),
            "errors": net_err,
            "warnings": f"NOT {net_err} AND {has('line', ': warning CS')}",
            "set_errors": num("line", net_sum, 1),
            "set_warnings": num("line", net_sum, 2),
            "event": f"CASE WHEN {net_err} THEN {located(NET)} END",
            "bad": "errors > 0",
            "text": "CASE WHEN errors > 0 THEN '✗ .NET build failed with ' || errors || ' errors' ELSE '✓ .NET operation successful' END",
        },
        "dbmigrate": {
            "fails": f"CASE WHEN {low_err} THEN 1 WHEN {mig_done} THEN 0 END",
            "errors": low_err,
            "event": f"CASE WHEN {low_err} THEN '✗ ' || line WHEN {mig_done} THEN '☑ ' || line WHEN {mig_run} THEN '→ ' || line END",
            "text": two("'✗ Migration failed'", "'✓ DB Migration finished'"),
        },
        "npm": {
            "fails": sticky(f"{npm_err} OR {has('line', 'failing')}"),
            "errors": npm_err,
            "warnings": f"NOT {npm_err} AND ({has('line', 'WARN')} OR {has(L, 'npm warn')})",
            "failed": has("line", "failing"),
            "passed": f"NOT {has('line', 'failing')} AND {has('line', 'passing')}",
            "mark": f"{npm_err} AND {has(L, 'missing script')}",
            "event": f"CASE WHEN {npm_err} THEN line END",
            "text": "CASE WHEN mark THEN '✗ Missing script error' WHEN failure THEN '✗ NPM execution failed' ELSE '✓ NPM execution completed' END",
        },
        "pnpm": {
            "fails": sticky(has("line", "ERR_PNPM_", "ERROR")),
            "errors": has("line", "ERR_PNPM_", "ERROR"),
            "event": f"CASE WHEN {has('line', 'ERR_PNPM_', 'ERROR')} THEN '✗ ' || line END",
            "text": two("'✗ pnpm command failed'", "'✓ pnpm command successful'"),
        },
        "yarn": {
            "fails": sticky(has("line", "error ", "ERROR")),
            "errors": has("line", "error ", "ERROR"),
            "event": f"CASE WHEN {has('line', 'error ', 'ERROR')} THEN '✗ ' || line END",
            "text": two("'✗ yarn command failed'", "'✓ yarn command successful'"),
        },
        "cargo": {
            "fails": f"CASE WHEN {cargo_ok} THEN CASE WHEN regexp_extract(line, {q(CARGO)}, 1) = 'FAILED' THEN 1 ELSE 0 END WHEN {cargo_err} THEN 1 END",
            "errors": cargo_err,
            "warnings": f"NOT {cargo_err} AND {has('line', 'warning:')}",
            "set_passed": f"CASE WHEN {cargo_ok} THEN {num('line', CARGO, 2)} END",
            "set_failed": f"CASE WHEN {cargo_ok} THEN {num('line', CARGO, 3)} END",
            "duration": f"CASE WHEN {cargo_ok} THEN CAST(regexp_extract(line, {q(CARGO)}, 7) AS DOUBLE) END",
            "event": f"CASE WHEN {cargo_err} OR {has('line', 'warning:')} THEN line END",
            "text": "'Cargo command finished'",
        },
        "git": {
            "warnings": f"argument = 'status' AND {starts('line', 'modified:')}",
            "event": f"CASE WHEN argument <> 'status' THEN NULL WHEN {starts('line', 'modified:')} THEN '☑ ' || line WHEN {starts('line', 'new file:')} THEN '✚ ' || line WHEN {has('line', 'branch')} THEN {q(chr(0xF418) + ' ')} || line END",
            "event2": f"CASE WHEN {rx('line', STAT)} THEN '⌛ ' || line END",
            "text": "CASE WHEN len(evs) > 0 THEN 'Git ' || argument || ' summary: ' ELSE 'Git ' || argument || ' execution finished.' END",
            "separator": "CASE WHEN len(evs) > 0 THEN ', ' ELSE '' END",
        },
    }


FOLDS = fold_rules()
FOLD_COLUMNS = (
    "exec_id, tool, CASE WHEN failure THEN 'failure' ELSE 'success' END AS status, summary, "
    "passed AS tests_passed, failed AS tests_failed, warnings, errors, duration AS duration_seconds, "
    "files AS test_files, modules AS modules_compiled, bundle AS bundle_size, "
    "artifact AS artifact_size, CAST(len(evs) AS BIGINT) AS event_count, separator"
)


def fold(family: str, keys: str) -> list[str]:
    """CTE `fold_<n>` for one family; `keys` selects exec_id, tool, argument."""
    rules = FOLDS[family]
    n = list(FOLDS).index(family)
    get = rules.get
    adds = ", ".join(
        f"coalesce({get(m, 'false')}, false) AS add_{m}" for m in ("errors", "warnings", "passed", "failed")
    )
    sets = ", ".join(
        f"CAST({get('set_' + m, 'NULL')} AS BIGINT) AS set_{m}" for m in ("errors", "warnings", "passed", "failed")
    )
    counts = ", ".join(
        f"""coalesce(max_by(set_{m}, line_no) FILTER (WHERE set_{m} IS NOT NULL), 0) +
      count(*) FILTER (WHERE add_{m} AND (reset IS NULL OR line_no > reset)) AS {m}"""
        for m in ("errors", "warnings", "passed", "failed")
    )

    def last(name: str, default: str) -> str:
        return f"coalesce(max_by({name}, line_no) FILTER (WHERE {name} IS NOT NULL), {default}) AS {name}"

    return [
        f"k{n} AS ({keys})",
        f"""e{n} AS (SELECT exec_id, line_no, {adds}, {sets}, CAST({get("fails", "NULL")} AS BIGINT) AS fails,
    CAST({get("files", "NULL")} AS BIGINT) AS files, CAST({get("modules", "NULL")} AS BIGINT) AS modules,
    CAST({get("bundle", "NULL")} AS VARCHAR) AS bundle, CAST({get("artifact", "NULL")} AS VARCHAR) AS artifact,
    CAST({get("duration", "NULL")} AS DOUBLE) AS duration, coalesce({get("mark", "false")}, false) AS mark,
    CAST({get("event", "NULL")} AS VARCHAR) AS ev1, CAST({get("event2", "NULL")} AS VARCHAR) AS ev2
  FROM clean JOIN k{n} USING (exec_id))""",
        f"""x{n} AS (SELECT *, max(CASE WHEN set_errors IS NOT NULL THEN line_no END)
    OVER (PARTITION BY exec_id) AS reset FROM e{n})""",
        f"""a{n} AS (SELECT exec_id, {counts}, {last("fails", "0")}, {last("files", "0")},
    {last("modules", "0")}, {last("bundle", "''")}, {last("artifact", "''")}, {last("duration", "0")},
    bool_or(mark) AS mark FROM x{n} GROUP BY exec_id)""",
        f"""v{n} AS (SELECT exec_id, list(ev ORDER BY line_no, step) AS evs FROM (
    SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY line_no, step) AS rn FROM (
      SELECT exec_id, line_no, 1 AS step, ev1 AS ev, {get("cap", "NULL")} AS lim FROM e{n}
      UNION ALL SELECT exec_id, line_no, 2, ev2, {get("cap2", "NULL")} FROM e{n}) WHERE ev IS NOT NULL)
    WHERE lim IS NULL OR rn <= lim GROUP BY exec_id)""",
        f"""m{n} AS (SELECT k.exec_id, k.tool, k.argument,
    coalesce(a.errors, 0) AS errors, coalesce(a.warnings, 0) AS warnings,
    coalesce(a.passed, 0) AS passed, coalesce(a.failed, 0) AS failed,
    coalesce(a.fails, 0) = 1 AS failing, coalesce(a.files, 0) AS files,
    coalesce(a.modules, 0) AS modules, coalesce(a.bundle, '') AS bundle,
    coalesce(a.artifact, '') AS artifact, coalesce(a.duration, 0) AS duration,
    coalesce(a.mark, false) AS mark, coalesce(v.evs, CAST([] AS VARCHAR[])) AS evs
  FROM k{n} k LEFT JOIN a{n} a USING (exec_id) LEFT JOIN v{n} v USING (exec_id))""",
        f"n{n} AS (SELECT *, failing OR coalesce({get('bad', 'false')}, false) AS failure FROM m{n})",
        f"fold_{n} AS (SELECT *, {rules['text']} AS summary, {get('separator', q(''))} AS separator FROM n{n})",
    ]


def fold_query(family: str) -> str:
    tool, argument = FORCED.get(family, family), FORCED_ARGUMENT.get(family, "")
    keys = f"SELECT DISTINCT exec_id, {q(tool)} AS tool, {q(argument)} AS argument FROM clean"
    n = list(FOLDS).index(family)
    return with_(
        [*LOGS, *clean(), *fold(family, keys)], f"SELECT {FOLD_COLUMNS} FROM fold_{n}"
    )


def generic(source: str, keys: str, name: str = "generic") -> list[str]:
    low = "lower(line)"
    return [
        f"""s0 AS (SELECT exec_id, idx, line, {rx("line", r"(?i)(?:ERROR|FAILED|PANIC)")} AS sign FROM {source})""",
        f"""s1 AS (SELECT * FROM s0 WHERE NOT (sign AND ({rx(low, r"0\s+errors?")} OR
    {has(low, "0 failures", "0 failed")})))""",
        f"""s2 AS (SELECT exec_id, count(*) FILTER (WHERE sign) AS errors,
    count(*) FILTER (WHERE {has(low, "warn")}) AS warnings,
    bool_or(sign AND {has(low, "error")}) AS is_error,
    bool_or({has(low, "build succeeded", "compiled successfully")}) AS succeeded,
    bool_or({has(low, "build succeeded", "compiled successfully", "build complete", "build finished", "dist/")}) AS completed,
    bool_or({has(low, "test")} AND {has(low, "completed", "passed", "finished")}) AS tested,
    (list(line ORDER BY idx) FILTER (WHERE sign))[1:10] AS evs FROM s1 GROUP BY exec_id)""",
        f"""{name} AS (SELECT k.exec_id, CASE WHEN coalesce(errors, 0) > 0 THEN 'failure' ELSE 'success' END AS status,
    CASE WHEN is_error AND completed THEN '✗ Completed with errors' WHEN is_error THEN '✗ Build failed'
         WHEN errors > 0 THEN '✗ Execution failed' WHEN succeeded THEN '✓ Build succeeded'
         WHEN completed THEN '✓ Build completed' WHEN tested THEN '✓ Tests completed'
         WHEN warnings > 0 THEN '⚠ Completed with warnings' ELSE '✓ Execution successful' END AS summary,
    coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
    coalesce(array_to_string(evs, chr(10)), '') AS events, CAST(coalesce(len(evs), 0) AS BIGINT) AS n_events, evs
  FROM ({keys}) k LEFT JOIN s2 USING (exec_id))""",
    ]


def summaries() -> list[str]:
    """All families at once: `summaries` with the columns of a fold query."""
    ctes = []
    for family in FOLDS:
        ctes += fold(
            family, f"SELECT exec_id, tool, argument FROM tools WHERE family = {q(family)}"
        )
    union = "\n  UNION ALL ".join(
        f"SELECT {FOLD_COLUMNS} FROM fold_{n}" for n in range(len(FOLDS))
    )
    return [
        *ctes,
        *generic("trunc", "SELECT exec_id FROM tools WHERE family = 'fallback'", "unknown_tool"),
        f"""summaries AS ({union}
  UNION ALL SELECT exec_id, 'fallback', status, summary, 0, 0, warnings, errors, 0, 0, 0, '', '', n_events, ''
    FROM unknown_tool)""",
    ]


def summary_parts_sql(rows_per_part: int = 64) -> str:
    out = []
    for n, rules in enumerate(FOLDS.values()):
        if "separator" not in rules:
            continue
        out.append(f"SELECT exec_id, 0::BIGINT AS part_no, summary AS text FROM fold_{n} WHERE separator <> ''")
        out.append(f"""SELECT exec_id, part_no, CASE WHEN row_number() OVER (PARTITION BY exec_id ORDER BY part_no) = 1
    THEN '' ELSE any_separator END || text FROM (
  SELECT exec_id, line_no // {rows_per_part} + 1 AS part_no, any_value(separator) AS any_separator,
         string_agg(ev, {{0}} ORDER BY line_no, step) AS text
  FROM (SELECT exec_id, line_no, 1 AS step, ev1 AS ev FROM e{n} UNION ALL SELECT exec_id, line_no, 2, ev2 FROM e{n})
  JOIN fold_{n} USING (exec_id) WHERE ev IS NOT NULL AND separator <> '' GROUP BY 1, 2)""".replace("{0}", "' | '" if rules is FOLDS["typescript"] else "', '"))
    return "\nUNION ALL ".join(out)


# ---------------------------------------------------------------- root cause and suggestions

# Fixed values, in order of precedence.
PATTERNS = (
    (1, "module_resolution", r"Module not found: Can't resolve '(.*?)'", "Module not found '", "'"),
    (1, "file_not_found", r"Cannot find file '(.*?)'", "Cannot find file '", "'"),
    (1, "build_failure", r"(?i)build failed:?\s*(.*)", "Build failed: ", ""),
    (2, "exception", r"(?i)Exception:\s*(.*)", "Exception: ", ""),
    (2, "panic", r"(?i)panic:\s*(.*)", "Panic: ", ""),
    (2, "fatal_error", r"(?i)fatal error:\s*(.*)", "Fatal error: ", ""),
    (3, "lint_error", r"\d+:\d+\s+error\s+(.*)", "", ""),
    (3, "generic_error", r"(?i)^Error:\s*(.*)", "", ""),
    (3, "generic_error", r"^ERROR\s+(.*)", "", ""),
    (4, "warning", r"(?i)^Warning:\s*(.*)", "", ""),
)


def causes() -> list[str]:
    all_hits = "\n  UNION ALL ".join(
        f"""SELECT exec_id, idx, {p} AS priority, {i} AS pattern_ix, {q(kind)} AS error_type,
    {q(before)} || regexp_extract(line, {q(pattern)}, 1) || {q(after)} AS cause
    FROM reduced WHERE {rx("line", pattern)}"""
        for i, (p, kind, pattern, before, after) in enumerate(PATTERNS)
    )
    return [
        f"all_hits AS ({all_hits})",
        """hits AS (SELECT exec_id, idx, CAST(priority AS BIGINT) AS priority,
    CAST(pattern_ix AS BIGINT) AS pattern_ix, error_type, cause FROM (
      SELECT *, row_number() OVER (PARTITION BY exec_id, idx ORDER BY pattern_ix) AS rn FROM all_hits)
  WHERE rn = 1)""",
        """best AS (SELECT exec_id, idx, priority, error_type, cause FROM (
    SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY priority, idx, pattern_ix) AS rn
    FROM hits) WHERE rn = 1)""",
    ]


def intel(changed: str = CHANGED) -> list[str]:
    return [
        *causes(),
        changed,
        """correlated AS (SELECT exec_id, list(path ORDER BY path) AS paths FROM (
    SELECT DISTINCT b.exec_id, c.path FROM best b JOIN changed c USING (exec_id)
    JOIN reduced r ON r.exec_id = b.exec_id AND r.idx BETWEEN b.idx - 5 AND b.idx + 4
    WHERE contains(r.line, c.path)) GROUP BY exec_id)""",
        """around AS (SELECT b.exec_id, string_agg(r.line, chr(10) ORDER BY r.idx) AS context FROM best b
  JOIN reduced r ON r.exec_id = b.exec_id AND r.idx BETWEEN b.idx - 1 AND b.idx + 1 GROUP BY 1)""",
        """intel AS (SELECT b.exec_id, b.error_type, a.context,
    coalesce(array_to_string(c.paths, chr(10)), '') AS correlated_changes,
    b.cause || CASE WHEN c.paths IS NOT NULL THEN chr(10) || chr(10) ||
      'Note: This error might be related to recent changes in: ' || array_to_string(c.paths, ', ')
      ELSE '' END AS root_cause
  FROM best b JOIN around a USING (exec_id) LEFT JOIN correlated c USING (exec_id))""",
    ]


# Fixed values, in order.
SUGGESTIONS = (
    ("module_resolution", "(?i)module not found|can't resolve", "Check import path or ensure the component exists."),
    ("file_not_found", "(?i)cannot find file", "Verify the file path and ensure it has not been renamed or deleted."),
    ("lint_error", "(?i)missing semicolon", "Add a semicolon at the indicated line."),
    ("build_failure", "(?i)gradle task failed", "Run: flutter clean && flutter pub get"),
    ("", "(?i)tests failed|test suite failed", "Inspect failing test cases and verify expected outputs."),
    ("generic_error", "(?i)address already in use|EADDRINUSE", "Port conflict detected. Try running: 'npx kill-port <port>' or use a different port."),
    ("", "(?i)out of memory|heap limit", "Process ran out of memory. Try increasing Node.js memory limit with: 'NODE_OPTIONS=--max-old-space-size=4096'"),
    ("", "(?i)permission denied|EACCES", "Permission error. Check file ownership or try running with elevated privileges."),
    ("", "(?i)ENOSPC|no space left on device", "Disk is full. Free up some space or check your temporary directory."),
    ("warning", "(?i)unused variable", "Remove the unused variable or prefix it with an underscore if intentional."),
)
EXTRA_SUGGESTIONS = (
    ("lint_error", "(?i)vue compiler macro", "Ensure you are using defineProps and defineEmits correctly inside <script setup> block natively."),
    ("exception", "(?i)MissingPluginException", "Run 'flutter clean' and 'flutter pub get' to rebuild generated plugin wrappers natively."),
)


def suggestions(rules=SUGGESTIONS) -> list[str]:
    union = "\n  UNION ALL ".join(
        f"""SELECT exec_id, {i} AS rule, {q(text)} AS suggestion FROM intel
    WHERE {f"lower(error_type) = {q(kind)} AND" if kind else ""} {rx("lower(root_cause)", pattern)}"""
        for i, (kind, pattern, text) in enumerate(rules)
    )
    return [
        f"rule_hits AS ({union})",
        """suggested AS (SELECT exec_id, string_agg(suggestion, chr(10) ORDER BY rule) AS suggestions
  FROM rule_hits GROUP BY exec_id)""",
    ]


# ---------------------------------------------------------------- whole records

KEY_EVENTS = f"""key_events AS (SELECT exec_id, idx, line FROM (
    SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY idx DESC) AS rn FROM reduced
    WHERE NOT {has(L, "progress", "downloading", "fetching")} AND
      {has(L, "error", "fail", "success", "build", "test", "built", "artifact")}) WHERE rn <= 15)"""
USAGE = """usage AS (SELECT user_id AS exec_id,
    max(CAST(floor(value * 1048576) AS BIGINT)) / 1048576.0::DOUBLE AS max_ram_mb,
    coalesce(avg(CASE WHEN event_id % 101 > 0 THEN (event_id % 101)::DOUBLE END), 0) AS avg_cpu_percent
  FROM events GROUP BY user_id)"""


#: Executions as a stream ends them: after 29 days at the latest, with -1 as exit code.
STREAMED = [
    TPL,
    EVENT_LINES,
    """spans AS (SELECT user_id AS exec_id, min(ts) AS s, max(ts) AS e, max(ts) > min(ts) + INTERVAL 29 DAY AS over
  FROM events GROUP BY user_id)""",
    """log_lines AS (SELECT exec_id, line_no, line FROM (
    SELECT l.exec_id, row_number() OVER (PARTITION BY l.exec_id ORDER BY event_id) - 1 AS line_no, line, ts
    FROM event_lines l JOIN events e USING (event_id)) JOIN spans USING (exec_id)
  WHERE ts <= CASE WHEN over THEN s + INTERVAL 29 DAY ELSE e END)""",
    CMD,
    EXECUTIONS.replace("executions AS (", "all_runs AS (", 1),
    """executions AS (SELECT a.exec_id, command_line, tokens, CASE WHEN over THEN -1 ELSE exit_code END AS exit_code,
    start_ts, end_ts FROM all_runs a JOIN spans USING (exec_id))""",
]


def records(source: list[str] | None = None, changed: str = CHANGED) -> list[str]:
    return [
        *(source or [*LOGS, *EXECS]),
        *clean(),
        *reduced(),
        *tools(),
        *summaries(),
        *intel(changed),
        *suggestions(),
        KEY_EVENTS,
        USAGE,
        *assembled(),
    ]


def assembled() -> list[str]:
    """Records from `summaries`, `executions`, `intel`, `suggested`, `key_events` and `usage`."""
    return [
        """key_lists AS (SELECT exec_id, string_agg('- ' || line, chr(10) ORDER BY idx) AS key_text
  FROM key_events GROUP BY exec_id)""",
        """bytes AS (SELECT exec_id, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS original_bytes
  FROM clean GROUP BY exec_id)""",
        """j0 AS (SELECT s.*, e.tokens[1] AS command, e.exit_code,
    ((epoch_us(e.end_ts) - epoch_us(e.start_ts) + 5000) // 10000) / 100.0::DOUBLE AS wall,
    e.exit_code <> 0 OR s.status = 'failure' AS failing FROM summaries s JOIN executions e USING (exec_id))""",
        """j1 AS (SELECT j0.exec_id, tool, command, CASE WHEN failing THEN 'failure' ELSE 'success' END AS status,
    summary || CASE WHEN failing AND root_cause IS NOT NULL THEN chr(10) || chr(10) || 'Root cause:' ||
      chr(10) || root_cause ELSE '' END AS summary, event_count, tests_passed, tests_failed, warnings, errors,
    test_files, modules_compiled, bundle_size, artifact_size, wall AS duration_seconds,
    coalesce(max_ram_mb, 0) AS max_ram_mb, coalesce(avg_cpu_percent, 0) AS avg_cpu_percent,
    coalesce(original_bytes, 0) AS original_bytes,
    CASE WHEN failing THEN coalesce(root_cause, '') ELSE '' END AS root_cause,
    CASE WHEN failing THEN coalesce(error_type, '') ELSE '' END AS error_type,
    CASE WHEN failing THEN coalesce(context, '') ELSE '' END AS context,
    CASE WHEN failing THEN coalesce(correlated_changes, '') ELSE '' END AS correlated_changes,
    CASE WHEN failing THEN coalesce(suggestions, '') ELSE '' END AS suggestions,
    'artifacts/' || j0.exec_id || '.log' AS artifact_path,
    CASE WHEN failing THEN 'artifacts/' || j0.exec_id || '.log' ELSE '' END AS raw_log_path, key_text
  FROM j0 LEFT JOIN intel USING (exec_id) LEFT JOIN suggested USING (exec_id)
  LEFT JOIN key_lists USING (exec_id) LEFT JOIN bytes USING (exec_id) LEFT JOIN usage USING (exec_id))""",
        """j2 AS (SELECT *, concat_ws(chr(10), 'Command: ' || command, 'Status: ' || status,
    CASE WHEN modules_compiled > 0 THEN 'Modules compiled: ' || modules_compiled END,
    CASE WHEN tests_passed > 0 THEN 'Tests passed: ' || tests_passed END,
    CASE WHEN tests_failed > 0 THEN 'Tests failed: ' || tests_failed END,
    CASE WHEN bundle_size <> '' THEN 'Bundle size: ' || bundle_size END,
    CASE WHEN artifact_size <> '' THEN 'Artifact size: ' || artifact_size END,
    CASE WHEN duration_seconds > 0 THEN 'Duration: ' || printf('%.2f', duration_seconds) || 's' END,
    CASE WHEN status <> 'success' AND key_text IS NOT NULL
      THEN chr(10) || 'Key Events:' || chr(10) || key_text END) AS compressed_context FROM j1)""",
        """records AS (SELECT *, octet_length(encode(compressed_context)) AS compressed_bytes FROM j2)""",
        """final AS (SELECT * EXCLUDE (key_text), round(CASE WHEN original_bytes > 0 THEN
    greatest((original_bytes - compressed_bytes)::DOUBLE / original_bytes * 100.0, 0) ELSE 0 END, 6)
    AS savings_percentage FROM records)""",
    ]


def pasted_records() -> list[str]:
    executions = (
        "pasted_runs AS (SELECT exec_id, 'analyze --raw ' || text AS command_line FROM pasted)"
    )
    return [
        TPL,
        EVENT_LINES,
        PASTED,
        PASTED_LINES,
        executions,
        *clean("pasted_lines"),
        *tools(source="pasted_runs"),
    ]


# The words of the ladder and its texts.
def explained() -> list[str]:
    """Single commands of `asked(command, pos, part)` explained in order."""
    low = "lower(part)"
    return [
        f"""ladder AS (SELECT *, CASE
    WHEN {has(low, "vitest")} AND {has(low, "--coverage")} THEN 1 WHEN {has(low, "vitest")} THEN 2
    WHEN {has(low, "tsc")} THEN 3 WHEN {has(low, "npm run build", "vite build")} THEN 4
    WHEN {has(low, "npm run dev", "npm start")} OR ({has(low, "vite")} AND NOT {has(low, "build")}) THEN 5
    WHEN {has(low, "npx ")} THEN 6 WHEN {has(low, "npm run test", "npm test")} THEN 7
    WHEN {has(low, "npm install", "npm i")} THEN 8 WHEN {has(low, "flutter build")} THEN 9
    WHEN {has(low, "flutter test")} THEN 10 WHEN {starts(low, "git ")} THEN 11 ELSE 12 END AS step FROM asked)""",
        "texts(step, type, tool, description) AS (VALUES "
        + ", ".join(
            f"({i}, {q(kind)}, {q(tool)}, {q(text)})"
            for i, (kind, tool, text) in enumerate(
                (
                    ("test", "vitest", "Runs Vitest tests and generates a code coverage report to see how much of the code is tested."),
                    ("test", "vitest", "Executes unit and widget tests using the Vitest test runner, highly optimized for Vite-based projects."),
                    ("typecheck", "typescript", "Performs static type checking on the codebase to ensure type safety."),
                    ("build", "vite", "Compiles the application for production. In modern Vue projects, this typically uses Vite/Rollup to bundle assets."),
                    ("dev", "vite", "Starts the development server with hot module replacement (HMR)."),
                    ("exec", "npx", "Executes a package-based command without having to install it globally."),
                    ("test", "npm", "Executes the test suite defined in package.json."),
                    ("install", "npm", "Installs project dependencies defined in package.json."),
                    ("build", "flutter", "Builds the Flutter application for the target platform."),
                    ("test", "flutter", "Runs unit or widget tests for the Flutter project."),
                    ("vcs", "git", "A version control command to manage source code history."),
                    ("unknown", "unknown", "Unknown command"),
                ),
                start=1,
            )
        )
        + ")",
        """single AS (SELECT l.command, l.pos, l.part, t.type, t.tool, t.description
  FROM ladder l JOIN texts t USING (step))""",
    ]


IS_CHAIN = has("command", " && ", " ; ", " || ")


def explained_all() -> list[str]:
    return [
        *HIST,
        COMMANDS,
        f"""cut AS (SELECT command, CASE WHEN {IS_CHAIN}
    THEN regexp_split_to_array(command, ' && | ; | \\|\\| ') ELSE [command] END AS parts FROM commands)""",
        f"""asked AS (SELECT command, pos, {trim("parts[pos]")} AS part FROM (
    SELECT command, parts, unnest(generate_series(1, len(parts))) AS pos FROM cut))""",
        *explained(),
        f"""explained AS (SELECT command, CASE WHEN {IS_CHAIN} THEN 'composite' ELSE max(type) END AS type,
    CASE WHEN {IS_CHAIN} THEN 'multitool' ELSE max(tool) END AS tool,
    CASE WHEN {IS_CHAIN} THEN 'This is a chained command execution:' || chr(10) || chr(10) ||
      string_agg(pos || '. **' || part || '**: ' || description, chr(10) || chr(10) ORDER BY pos)
        FILTER (WHERE part <> '')
      ELSE max(description) END AS description FROM single GROUP BY command)""",
    ]


# ---------------------------------------------------------------- registry


def oracle_sql() -> dict[str, str]:
    cleaned = [*LOGS, *clean()]
    on_reduced = [*cleaned, *reduced()]
    detected = [*cleaned, *EXECS]
    final = records()
    any_word = {
        name: " OR ".join(
            has(f"lower({c})", w) for w in query.lower().split() for c in ("command", "summary", "status")
        )
        or "false"
        for name, query in SEARCHES.items()
    }
    generic_out = "SELECT exec_id, status, summary, errors, warnings, events FROM generic"
    noisy = """noisy AS (SELECT exec_id, line_no, CASE line_no % 4
    WHEN 0 THEN 'WARNING in Node_Modules/x: ' || line WHEN 1 THEN '[INFO] Downloading ' || line
    WHEN 2 THEN 'see [info] fetching ' || line ELSE line END AS line FROM log_lines)"""

    def trimmed(source: str) -> str:
        return (
            f"trimmed AS (SELECT * FROM (SELECT exec_id, line_no, {trim('line')} AS line "
            f"FROM {source}) WHERE line <> '')"
        )

    tool_events_sql = (
            "\nUNION ALL ".join(
                f"""SELECT exec_id, line_no, step, ev AS event FROM (
  SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY line_no, step) AS rn FROM (
    SELECT exec_id, line_no, 1::BIGINT AS step, ev1 AS ev, {r.get("cap", "NULL")} AS lim FROM e{n}
    UNION ALL SELECT exec_id, line_no, 2, ev2, {r.get("cap2", "NULL")} FROM e{n})
  WHERE ev IS NOT NULL) WHERE lim IS NULL OR rn <= lim"""
                for n, r in enumerate(FOLDS.values())
            )
            + """
UNION ALL SELECT exec_id, i - 1 AS line_no, 0, evs[i] FROM (
  SELECT exec_id, evs, unnest(range(1, len(evs) + 1)) AS i FROM unknown_tool WHERE evs IS NOT NULL)"""
    )
    whole_events = [
        f"all_events AS ({tool_events_sql})",
        f"texts AS ({summary_parts_sql()})",
        """listed AS (SELECT exec_id, string_agg(event, chr(10) ORDER BY line_no, step) AS important_events
  FROM all_events GROUP BY exec_id)""",
        "spelled AS (SELECT exec_id, string_agg(text, '' ORDER BY part_no) AS text FROM texts GROUP BY exec_id)",
    ]
    json_numbers = ", ".join(
        f"round({n}::DOUBLE, 6) AS {n}"
        for n in (
            "tests_passed", "tests_failed", "warnings", "errors", "duration_seconds", "max_ram_mb", "avg_cpu_percent",
            "test_files", "modules_compiled", "original_bytes", "compressed_bytes", "savings_percentage",
        )
    )
    sql = {
        "split_log_blob": with_([DOC_LINES], "SELECT exec_id, line_no, line FROM doc_lines"),
        "read_log_dir": with_(
            [TPL, EVENT_LINES, PASTED, PASTED_LINES], "SELECT exec_id, line_no, line FROM pasted_lines"
        ),
        "history_load": with_(
            HIST,
            """SELECT execution_id, command, status,
  CASE WHEN o_orderkey % 20 = 1 THEN '' ELSE summary END AS summary
FROM history WHERE o_orderkey % 20 NOT IN (0, 2, 3, 4, 5, 6, 7)
UNION ALL SELECT '', '', '', '' FROM history WHERE o_orderkey % 20 = 6""",
        ),
        "sanitize_utf8": "SELECT doc_id, octet_length(encode(t)) AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, chr(1) || chr(65533) || text[1:10] || chr(65533) || text[11:] AS t FROM documents)",
        "merge_streams": """SELECT user_id AS exec_id, row_number() OVER (PARTITION BY user_id
    ORDER BY date_trunc('hour', ts), event_id) - 1 AS line_no,
  CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
  event_type || ' ' || event_id AS line FROM events""",
        "write_clean_logs": with_(cleaned, "SELECT exec_id, line_no, line FROM clean"),
        "log_manifest": with_(
            cleaned,
            """SELECT 'artifacts/' || exec_id || '.log' AS raw_log_path, exec_id, min(line_no) AS first_line,
  max(line_no) AS last_line, count(*) AS lines FROM clean GROUP BY exec_id""",
        ),
        "raw_log": with_(
            final,
            """SELECT f.raw_log_path, c.exec_id, c.line_no, c.line FROM final f JOIN clean c USING (exec_id)
WHERE f.raw_log_path <> ''""",
        ),
        "write_summaries": with_(
            final,
            """SELECT exec_id, tool, status, summary, CAST(errors AS BIGINT) AS errors, savings_percentage,
  CASE WHEN tool = 'fallback' THEN 'execution_summary.json' WHEN tool IN ('pytest', 'jest') THEN 'test_results.json'
    WHEN tool = 'cargo' THEN 'build_summary.json' ELSE tool || '_summary.json' END AS artifact_name FROM final""",
        ),
        "history_append": with_(HIST, "SELECT execution_id, command, status, summary FROM history"),
        "artifact_routing": with_(
            [*detected, *tools()],
            """SELECT exec_id, CASE WHEN tool = 'fallback' THEN 'execution_summary.json'
  WHEN tool IN ('pytest', 'jest') THEN 'test_results.json' WHEN tool = 'cargo' THEN 'build_summary.json'
  ELSE tool || '_summary.json' END AS artifact_name FROM tools""",
        ),
        "strip_ansi": with_(
            LOGS,
            f"SELECT exec_id, line_no, regexp_replace(line, {q(ANSI)}, '', 'g') AS line FROM log_lines",
        ),
        "strip_timestamp": with_(
            LOGS, f"SELECT exec_id, line_no, regexp_replace(line, {q(TS)}, '') AS line FROM log_lines"
        ),
        "trim_ws": with_(LOGS, f"SELECT exec_id, line_no, {trim('line')} AS line FROM log_lines"),
        "dedupe_consecutive": with_(
            [
                DOC_LINES,
                """d AS (SELECT *, lag(line) OVER (PARTITION BY exec_id ORDER BY line_no) AS prev
  FROM doc_lines)""",
            ],
            "SELECT exec_id, line_no, line FROM d WHERE line IS DISTINCT FROM prev",
        ),
        "clean_lines": with_(cleaned, "SELECT exec_id, line_no, line FROM clean"),
        "sample_head": with_(
            [*cleaned, *by_content()], "SELECT exec_id, line_no, line FROM samples"
        ),
        "decompose_chain": with_([*EXECS, *by_command()], "SELECT exec_id, part_no, part FROM parts"),
        "tokenise_command": with_(
            [*EXECS, *by_command()],
            """SELECT exec_id, part_no, w[1] AS sub_command, array_to_string(w[2:], '|') AS sub_args
FROM tokens""",
        ),
        "detect_by_command": with_(
            [*EXECS, *by_command()], "SELECT exec_id, tool, family, argument FROM by_command"
        ),
        "detect_by_content": with_(
            [*cleaned, *by_content()], "SELECT exec_id, tool, family FROM by_content"
        ),
        "detect_tool": with_(
            [*detected, *tools()], "SELECT exec_id, tool, family, argument FROM tools"
        ),
        "detect_tool_extended": with_(
            [*detected, *tools(EXTENDED)], "SELECT exec_id, tool, family, argument FROM tools"
        ),
        "detect_pasted": with_(
            pasted_records(), "SELECT exec_id, tool, family, argument FROM tools"
        ),
        **{
            f"fold_{f.replace(' ', '_').replace('-', '_')}": fold_query(f) for f in FOLDS
        },
        "fold_fallback": with_(
            [*cleaned, *rle(), *truncate(), *generic("trunc", "SELECT DISTINCT exec_id FROM trunc")],
            generic_out,
        ),
        "summarize_tools": with_(
            [*detected, *rle(), *truncate(), *tools(), *summaries()], "SELECT * FROM summaries"
        ),
        "tool_events": with_(
            [*detected, *rle(), *truncate(), *tools(), *summaries()],
            tool_events_sql,
        ),
        "summary_parts": with_(
            [
                *final,
                f"texts AS ({summary_parts_sql()})",
                "ends AS (SELECT exec_id, max(part_no) + 1 AS part_no FROM texts GROUP BY exec_id)",
            ],
            """SELECT * FROM texts
UNION ALL SELECT exec_id, part_no, chr(10) || chr(10) || 'Root cause:' || chr(10) || root_cause
FROM ends JOIN j1 USING (exec_id) WHERE root_cause <> ''""",
        ),
        "rle_lines": with_(
            [DOC_LINES, trimmed("doc_lines"), *rle("trimmed")],
            "SELECT exec_id, idx, line FROM rle",
        ),
        "truncate_head_tail": with_(
            [
                """long_log AS (SELECT event_type AS exec_id,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
    event_type || ' ' || event_id AS line FROM events)""",
                *truncate("long_log"),
            ],
            "SELECT exec_id, idx, line FROM trunc",
        ),
        "filter_dep_noise": with_(
            [*LOGS, noisy], f"SELECT exec_id, line_no, line FROM noisy WHERE NOT {NOISE}"
        ),
        "dedupe_surviving": with_(
            [
                *LOGS,
                trimmed("log_lines"),
                f"""d AS (SELECT *, lag(line) OVER (PARTITION BY exec_id ORDER BY line_no) AS prev
  FROM trimmed WHERE NOT {NOISE})""",
            ],
            "SELECT exec_id, line_no, line FROM d WHERE line IS DISTINCT FROM prev",
        ),
        "group_pass_fail": with_(
            [*LOGS, trimmed("log_lines"), *grouped("trimmed", "line_no")],
            "SELECT exec_id, idx, line FROM grouped",
        ),
        "reduce_lines": with_(on_reduced, "SELECT exec_id, idx, line FROM reduced"),
        "semantic_summary": with_(
            [*on_reduced, *generic("reduced", "SELECT DISTINCT exec_id FROM reduced")], generic_out
        ),
        "analyze_logs": with_(
            [
                TPL,
                EVENT_LINES,
                PASTED,
                PASTED_LINES,
                *clean("pasted_lines"),
                *reduced(),
                *generic("reduced", "SELECT exec_id FROM pasted"),
            ],
            generic_out,
        ),
        "analyze_logs_full": with_(
            [
                *pasted_records(),
                *reduced(),
                *summaries(),
                *intel("changed AS (SELECT '' AS exec_id, '' AS path WHERE false)"),
                *suggestions(),
                KEY_EVENTS,
                "usage AS (SELECT '' AS exec_id, 0::DOUBLE AS max_ram_mb, 0::DOUBLE AS avg_cpu_percent WHERE false)",
                """executions AS (SELECT exec_id, ['analyze'] AS tokens, 0 AS exit_code, TIMESTAMP '1970-01-01' AS start_ts,
    TIMESTAMP '1970-01-01' AS end_ts FROM pasted)""",
                *assembled(),
            ],
            "SELECT * FROM final",
        ),
        "match_error_patterns": with_(
            [*on_reduced, *causes()],
            "SELECT exec_id, idx, priority, pattern_ix, error_type, cause FROM hits",
        ),
        "root_cause": with_(
            [*on_reduced, *causes()], "SELECT exec_id, idx, priority, error_type, cause FROM best"
        ),
        "error_context": with_(
            [*on_reduced, *causes()],
            """SELECT r.exec_id, r.idx, r.line FROM best b JOIN reduced r
  ON r.exec_id = b.exec_id AND r.idx BETWEEN b.idx - 1 AND b.idx + 1""",
        ),
        "correlate_changes": with_(
            [*on_reduced, *intel()],
            "SELECT exec_id, array_to_string(paths, chr(10)) AS correlated_changes FROM correlated",
        ),
        "changed_files": f"""SELECT exec_id, path FROM (SELECT o_custkey AS exec_id, CASE o_orderkey % 6
  WHEN 0 THEN {trim("' src/f' || o_orderkey || '.ts '")}
  WHEN 1 THEN '' WHEN 2 THEN 'src/é' || o_orderkey || '.ts' WHEN 3 THEN 'new' || o_orderkey || '.txt'
  WHEN 4 THEN 'a' || o_orderkey || ' -> b' ELSE '' END AS path FROM orders) WHERE path <> ''""",
        "suggest_fixes": with_(
            [*on_reduced, *intel(), *suggestions()], "SELECT exec_id, suggestions FROM suggested"
        ),
        "suggest_fixes_ext": with_(
            [*on_reduced, *intel(), *suggestions((*EXTRA_SUGGESTIONS, *SUGGESTIONS))],
            "SELECT exec_id, suggestions FROM suggested",
        ),
        "final_status": with_(final, "SELECT exec_id, status FROM final"),
        "key_events": with_([*on_reduced, KEY_EVENTS], "SELECT exec_id, idx, line FROM key_events"),
        "digest": with_(final, "SELECT exec_id, compressed_context FROM final"),
        "byte_savings": with_(
            final, "SELECT exec_id, original_bytes, compressed_bytes, savings_percentage FROM final"
        ),
        "original_bytes": with_(
            [DOC_LINES, *clean("doc_lines")],
            """SELECT exec_id, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS original_bytes
FROM clean GROUP BY exec_id""",
        ),
        "resource_usage": with_([USAGE], "SELECT * FROM usage"),
        "execution_summary": with_(
            [*final, *whole_events],
            """SELECT f.* REPLACE (CASE WHEN text IS NULL THEN summary ELSE text || CASE WHEN root_cause <> '' THEN chr(10) || chr(10) ||
    'Root cause:' || chr(10) || root_cause ELSE '' END END AS summary), coalesce(important_events, '') AS important_events
FROM final f LEFT JOIN listed USING (exec_id) LEFT JOIN spelled USING (exec_id)""",
        ),
        "execution_summary_blocks": with_(final, "SELECT * FROM final"),
        "test_report": with_(
            final, "SELECT exec_id, status, tests_passed, tests_failed FROM final"
        ),
        "build_report": with_(
            final,
            """SELECT exec_id, status, summary, tests_passed, tests_failed, warnings, errors,
  round(duration_seconds, 6) AS duration_seconds, round(max_ram_mb, 6) AS max_ram_mb,
  round(avg_cpu_percent, 6) AS avg_cpu_percent, test_files, modules_compiled, bundle_size, artifact_size,
  original_bytes, compressed_bytes, savings_percentage FROM final""",
        ),
        "agent_json": with_(
            final,
            f"""SELECT exec_id, error_type, root_cause, compressed_context, artifact_size, bundle_size,
  raw_log_path AS raw_log_fallback, context, correlated_changes, {json_numbers} FROM final""",
        ),
        "summary_json": with_(
            final,
            f"""SELECT exec_id, tool, command, status, summary, exec_id::VARCHAR AS execution_id, error_type, root_cause,
  artifact_path, raw_log_path, compressed_context, bundle_size, artifact_size, context, correlated_changes, suggestions,
  {json_numbers}, event_count::DOUBLE AS event_count FROM final""",
        ),
        "record_json": with_(
            [
                *final,
                f"all_events AS ({tool_events_sql})",
                f"texts AS ({summary_parts_sql()})",
                """listed AS (SELECT exec_id, string_agg(event, chr(10) ORDER BY line_no, step) AS important_events
  FROM all_events GROUP BY exec_id)""",
                "spelled AS (SELECT exec_id, string_agg(text, '' ORDER BY part_no) AS text FROM texts GROUP BY exec_id)",
            ],
            f"""SELECT f.exec_id, tool, command, status,
  CASE WHEN text IS NULL THEN summary ELSE text || CASE WHEN root_cause <> '' THEN chr(10) || chr(10) || 'Root cause:' ||
    chr(10) || root_cause ELSE '' END END AS summary,
  f.exec_id::VARCHAR AS execution_id, error_type, root_cause, artifact_path, raw_log_path, compressed_context, bundle_size,
  artifact_size, context, correlated_changes, suggestions, coalesce(important_events, '') AS important_events, {json_numbers}
FROM final f LEFT JOIN listed USING (exec_id) LEFT JOIN spelled USING (exec_id)""",
        ),
        "engine_counters": with_(
            EXECS,
            """SELECT count(*) AS commands_executed, count(*) FILTER (WHERE exit_code <> 0) AS command_failures
FROM executions""",
        ),
        "savings_by_tool": with_(
            final,
            """SELECT tool, count(*) AS executions, round(avg(original_bytes), 4) AS avg_original_bytes,
  round(avg(compressed_bytes), 4) AS avg_digest_bytes, round(avg(savings_percentage), 4) AS avg_reduction
FROM final GROUP BY tool""",
        ),
        "history_list": with_(
            HIST,
            """SELECT row_number() OVER (ORDER BY ts, execution_id) AS entry_no, execution_id, command,
  status, summary FROM history""",
        ),
        "history_search": with_(
            HIST,
            "\nUNION ALL ".join(
                f"SELECT {q(name)} AS query_id, execution_id, command, status, summary FROM history WHERE {test}"
                for name, test in any_word.items()
            ),
        ),
        "explain_command": with_(
            [
                *HIST,
                COMMANDS,
                "asked AS (SELECT command, 1 AS pos, command AS part FROM commands)",
                *explained(),
            ],
            "SELECT command, type, tool, description FROM single",
        ),
        "explain_chain": with_(
            explained_all(), "SELECT command, type, tool, description FROM explained"
        ),
        "explain_headline": with_(
            explained_all(),
            "SELECT command, split_part(description, chr(10), 1) AS headline FROM explained",
        ),
        "project_type": """SELECT project, CASE WHEN flutter THEN 'Flutter' WHEN vite THEN 'Vue (Vite)'
  WHEN node THEN 'Node.js (Standard)' ELSE 'Unknown Environment' END AS project_type,
  NOT flutter AND vite AS vite_detected
FROM (SELECT o_custkey AS project, bool_or(o_orderkey % 5 = 0) AS flutter,
        bool_or(o_orderkey % 5 = 1) AS vite, bool_or(o_orderkey % 5 = 2) AS node
      FROM orders GROUP BY o_custkey)""",
        "tool_matrix": "WITH " + """seen AS (SELECT user_id AS host, event_id % 7 AS t FROM events),
vite AS (SELECT o_custkey AS host FROM orders GROUP BY o_custkey
  HAVING bool_or(o_orderkey % 5 = 1) AND NOT bool_or(o_orderkey % 5 = 0))
SELECT host, """
        + ", ".join(
            f"CASE WHEN bool_or(t = {i}) THEN 'installed' ELSE 'not found' END AS {name}"
            for i, name in enumerate(("node", "npm", "pnpm", "flutter", "dart", "git"))
        )
        + """, CASE WHEN host IN (SELECT host FROM vite) THEN 'detected'
  WHEN bool_or(t = 6) THEN 'installed' ELSE 'not found' END AS vite FROM seen GROUP BY host""",
        "stream_clean": with_(
            cleaned, "SELECT exec_id, line_no, line, false AS late FROM clean"
        ),
        "stream_summaries": with_(
            records(STREAMED, "changed AS (SELECT 0::BIGINT AS exec_id, '' AS path WHERE false)"),
            "SELECT exec_id::VARCHAR AS execution_id, command, status, summary FROM final",
        ),
        "stream_heartbeat": """WITH RECURSIVE t AS (
  SELECT user_id AS exec_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
r AS (
  SELECT exec_id, n, us AS last, NULL::BIGINT AS beat, NULL::BIGINT AS since FROM t WHERE n = 1
  UNION ALL
  SELECT t.exec_id, t.n, CASE WHEN us - last > 86400000000 THEN us ELSE last END,
    CASE WHEN us - last > 86400000000 THEN us END, CASE WHEN us - last > 86400000000 THEN (us - last) // 1000 END
  FROM r JOIN t ON t.exec_id = r.exec_id AND t.n = r.n + 1)
SELECT exec_id, beat AS at_us, since AS since_ms FROM r WHERE beat IS NOT NULL""",
        "stream_counters": with_(
            EXECS,
            """SELECT count(*) AS commands_executed, count(*) FILTER (WHERE exit_code <> 0) AS command_failures
FROM executions""",
        ),
        "stream_history": with_(HIST, "SELECT execution_id, command, status, summary FROM history"),
    }
    same = {
        "clean_lines_blocks": "clean_lines",
        "rle_lines_blocks": "rle_lines",
        "group_pass_fail_blocks": "group_pass_fail",
        "tool_events_blocks": "tool_events",
        "suggest_fixes_by_table": "suggest_fixes",
        "root_cause_by_table": "root_cause",
        "history_index": "history_search",
    }
    sql["detect_by_content_table"] = with_([*cleaned, *by_content()], "SELECT exec_id, family FROM by_content")
    sql["compress_lines_blocks"] = with_(
        [DOC_LINES, *clean("doc_lines"), *rle(), *truncate()], "SELECT exec_id, idx, line FROM trunc"
    )
    return sql | {name: sql[plain] for name, plain in same.items()}



