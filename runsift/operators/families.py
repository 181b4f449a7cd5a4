"""Rule families: one per tool whose log we understand.

A family is data for the fold in `folds.py`, written as SQL snippets:

* `by_command(c, a1, a2)` and `by_content` (over `line`, `low`) tell whether it claims an
  execution; c is the sub-command, a1 and a2 its first arguments;
* `effects` says what one cleaned line does to the metrics, over `line`, `low` (its lower case)
  and `argument` (the first argument of the sub-command);
* `text` is the summary over the final metrics (tests, counters, `failure`, `tool`, `argument`,
  `events` as their number), and `bad` a condition over them that also means failure.

Effects are of three kinds: `add_*` (count the line), `set_*` (last value wins) and `fails`
(true sets the status to failure, false back to success; the last setter wins). `event` and
`event2` are texts to list; `event_cap` and `event2_cap` bound how many are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from runsift.functions.sqltext import (
    any_of,
    ends,
    extract,
    first_word,
    group,
    group_int,
    has,
    leading_int,
    lit,
    match,
    starts,
    trim,
    true_if,
    when,
)

CHECK, CROSS, WARN = "✓ ", "✗ ", "⚠ "
RED = lit(CROSS)
TRIMMED = trim("line")


@dataclass(frozen=True)
class RuleFamily:
    name: str
    effects: Mapping[str, str] = field(default_factory=dict)
    text: str = "''"
    bad: str = "false"
    by_command: Callable[[str, str, str], str] | None = None
    by_content: str | None = None
    # A family with keywords names the tool after the first keyword found.
    command_keywords: tuple[str, ...] = ()
    content_keywords: tuple[str, ...] = ()
    event_cap: int | None = None
    event2_cap: int | None = None
    # What stands between the events where the text goes on with all of them; null elsewhere.
    separator: str | None = None
    # Conditions that several effects repeat word for word; they are evaluated once per line.
    flags: tuple[str, ...] = ()

    def command_tool(self, c: str) -> str:
        return first_word(c, self.command_keywords) if self.command_keywords else lit(self.name)

    def content_tool(self) -> str:
        words = self.content_keywords
        return first_word("low", words) if words else lit(self.name)


def _npm_script(c: str, a1: str, a2: str, *scripts: str) -> str:
    names = ", ".join(lit(s) for s in scripts)
    return f"({c} = 'npm' AND {a1} = 'run' AND {a2} IN ({names}))"


def _by_failure(bad: str, good: str) -> str:
    return f"if(failure, {lit(bad)}, {lit(good)})"


def _by_tests(bad: tuple[str, str], good: tuple[str, str], neither: str) -> str:
    """Failed tests first, then passed tests, then a neutral text."""
    return (
        f"CASE WHEN failed > 0 THEN concat({lit(bad[0])}, failed, {lit(bad[1])}) "
        f"WHEN passed > 0 THEN concat({lit(good[0])}, passed, {lit(good[1])}) "
        f"ELSE {lit(neither)} END"
    )


def _located(pattern: str, otherwise: str) -> str:
    place = f"{extract('line', pattern, 1)}, ':', {extract('line', pattern, 2)}"
    return (
        f"CASE WHEN {match('line', pattern)} "
        f"THEN concat({RED}, {place}, ' - ', {extract('line', pattern, 5)}) "
        f"ELSE concat({RED}, {otherwise}) END"
    )


def _red_lines(condition: str, mark: str = CROSS) -> dict[str, str]:
    """Lines that fail the run, count as errors and are listed."""
    return {
        "fails": true_if(condition),
        "add_errors": condition,
        "event": when(condition, lit(mark), TRIMMED),
    }


# Tool keywords in order of precedence.
BUNDLERS = ("webpack", "rollup", "esbuild", "next", "nuxt", "turbopack")
BUNDLER_SIGNS = ("webpack", "rollup", "esbuild", "next.js", "nuxt", "compiled successfully")
FORMATTERS = ("prettier", "stylelint")
MIGRATORS = ("prisma", "migrate", "sequelize", "drizzle", "alembic", "knex")

_vitest_red = f"({has('line', 'FAIL', 'failed')} AND {starts('line', 'FAIL ', CROSS)})"
_vitest_failed = (
    f"coalesce({group_int('line', r'(\d+)\s+failing', needs='failing')}, "
    f"{group_int('line', r'Tests\s+(\d+)\s+failed', needs='Tests')})"
)
# Fixed values in all families below: the patterns, words and numbers of capture groups by which
# lines are told, the texts of summaries and events, and the caps of events.
VITEST = RuleFamily(
    "vitest",
    {
        "fails": true_if(f"{_vitest_red} OR {_vitest_failed} IS NOT NULL"),
        "set_files": group_int("line", r"Test Files\s+(\d+)\s+passed", needs="Test Files"),
        "set_passed": (
            f"coalesce({group_int('line', r'(\d+)\s+passing', needs='passing')}, "
            f"{group_int('line', r'Tests\s+(\d+)\s+passed', needs='Tests')})"
        ),
        "set_failed": _vitest_failed,
        "event": when(_vitest_red, "line"),
    },
    _by_tests((CROSS, " tests failed"), (CHECK, " tests passed"), "Test execution completed"),
    "failed > 0",
    lambda c, a1, a2: any_of(f"{c} IN ('vitest', 'jest')", _npm_script(c, a1, a2, "test")),
    has("line", "vitest", "Test Files", "PASS ", "FAIL "),
    flags=(_vitest_red,),
)

_jest_totals = r"Tests:\s+(\d+) failed,\s+(\d+) passed,\s+(\d+) total"
JEST = RuleFamily(
    "jest",
    {
        "fails": true_if(f"{has('line', ' FAIL ')} OR {group_int('line', _jest_totals, needs='Tests:')} > 0"),
        "set_failed": group_int("line", _jest_totals, 1, "Tests:"),
        "set_passed": group_int("line", _jest_totals, 2, "Tests:"),
        "event": when(has("line", " FAIL "), RED, TRIMMED),
    },
    _by_tests(
        (CROSS + "Jest failed: ", " failed"),
        (CHECK + "Jest passed: ", " passed"),
        "Jest execution completed.",
    ),
    "failed > 0",
    lambda c, a1, a2: ends(c, "jest"),
    has("line", "jest", "FAIL", "PASS", "Test Suites:"),
    flags=(has("line", " FAIL "),),
)

_playwright_totals = r"(\d+) passed.*\(.*\)\s+(\d+) failed"
PLAYWRIGHT = RuleFamily(
    "playwright",
    {
        **_red_lines(has("line", " Error: ")),
        "set_passed": group_int("line", _playwright_totals, 1, " passed"),
        "set_failed": group_int("line", _playwright_totals, 2, " passed"),
    },
    _by_tests(
        (CROSS + "Playwright failed: ", " failed"),
        (CHECK + "Playwright passed: ", " passed"),
        "Playwright execution completed.",
    ),
    "failed > 0",
    lambda c, a1, a2: has(c, "playwright"),
    flags=(has("line", " Error: "),),
)

_cypress_red = has("line", " (failed)", " ✖ ")
CYPRESS = RuleFamily(
    "cypress",
    {
        "fails": true_if(_cypress_red),
        "add_failed": _cypress_red,
        "add_passed": f"NOT {_cypress_red} AND {has('line', ' (passed)', ' ✔ ')}",
        "event": when(_cypress_red, RED, TRIMMED),
    },
    _by_tests(
        (CROSS + "Cypress failed: ", " failing"),
        (CHECK + "Cypress passed: ", " passing"),
        "Cypress execution completed",
    ),
    "failed > 0",
    lambda c, a1, a2: has(c, "cypress"),
    has("line", "cypress", "Run Finished", "Tests Results:"),
    flags=(_cypress_red,),
)

_pytest_totals = r"={2,}\s+(.*?)\s+in\s+([\d\.]+)s\s+={2,}"
_pytest_section = has("line", "FAILURES", "ERRORS")
_pytest_detail = f"(NOT {_pytest_section} AND {starts('line', 'E   ')})"


def _pytest_outcome(word: str, earlier: str) -> str:
    """Leading number of the last comma-separated part that names `word` and no earlier one."""
    part = f"(?:(?!{earlier})[^,])*" if earlier else "[^,]*"
    pattern = rf"(?d)^(?:.*,)?({part}{word}{part})(?:,.*)?\z"
    totals = extract("line", _pytest_totals, 1)
    token = (
        f"regexp_extract({trim(f'regexp_extract({totals}, {lit(pattern)}, 1)')}, "
        f"{lit(r'^[^\p{IsWhite_Space}]+')}, 0)"
    )
    return (
        f"CASE WHEN {match('line', _pytest_totals, '==')} AND {totals} RLIKE {lit(pattern)} "
        f"THEN {leading_int(token)} END"
    )


_pytest_failed = _pytest_outcome("failed", "passed")
PYTEST = RuleFamily(
    "pytest",
    {
        "fails": true_if(f"{_pytest_section} OR {_pytest_failed} IS NOT NULL"),
        "add_errors": _pytest_detail,
        "set_passed": _pytest_outcome("passed", ""),
        "set_failed": _pytest_failed,
        "set_warnings": _pytest_outcome("warning", "passed|failed"),
        "set_duration": when(
            match("line", _pytest_totals, "=="),
            f"coalesce(try_cast({extract('line', _pytest_totals, 2)} AS DOUBLE), 0D)",
        ),
        "event": (
            f"CASE WHEN {_pytest_section} THEN 'Found failures/errors section' "
            f"WHEN {_pytest_detail} THEN line END"
        ),
    },
    f"CASE WHEN failed > 0 OR errors > 0 THEN concat({lit(CROSS + 'Pytest failed: ')}, failed, "
    f"' failed') WHEN passed > 0 THEN concat({lit(CHECK + 'Pytest passed: ')}, passed, ' passed') "
    "ELSE 'Pytest execution completed.' END",
    "failed > 0 OR errors > 0",
    lambda c, a1, a2: any_of(
        ends(c, "pytest"), f"({c} = 'python' AND {a1} = '-m' AND {a2} = 'pytest')"
    ),
    any_of(
        has("line", "test session starts", "pytest"),
        f"({has('line', '===')} AND {has('line', 'passed in')})",
    ),
    flags=(_pytest_section, _pytest_detail),
)

# First hit wins.
_go_kind = (
    f"CASE WHEN {has('line', '--- FAIL:')} THEN 'red' WHEN {has('line', '--- PASS:')} THEN 'green' "
    f"WHEN {starts('line', 'FAIL' + chr(9))} THEN 'red suite' "
    f"WHEN {starts('line', 'ok' + chr(9), 'PASS')} THEN 'green suite' "
    f"WHEN {has('line', 'build failed', 'build errors')} THEN 'build' END"
)
GO_TEST = RuleFamily(
    "go test",
    {
        "fails": true_if(f"({_go_kind}) IN ('red', 'red suite', 'build')"),
        "add_failed": f"({_go_kind}) = 'red'",
        "add_passed": f"({_go_kind}) = 'green'",
        "add_errors": f"({_go_kind}) = 'build'",
        "event": (
            f"CASE {_go_kind} WHEN 'red' THEN line "
            f"WHEN 'red suite' THEN concat('Test suite failed: ', {TRIMMED}) "
            f"WHEN 'green suite' THEN concat('Test suite passed: ', {TRIMMED}) "
            "WHEN 'build' THEN concat('Build error: ', line) END"
        ),
    },
    f"if(failure, concat({lit(CROSS + 'Go Tests Failed. Passed: ')}, passed, ', Failed: ', failed), "
    f"concat({lit(CHECK + 'Go Tests Passed. Passed: ')}, passed))",
    "failed > 0 OR errors > 0",
    lambda c, a1, a2: f"({c} = 'go' AND {a1} = 'test')",
    starts("line", "--- PASS:", "--- FAIL:", "ok\t", "FAIL\t"),
)

_flutter_red = has("line", "EXCEPTION: ", "Exception: ")
_flutter_all = r"\+(\d+):\s*All tests passed!"
_flutter_some = r"\+(\d+)\s*-(\d+):\s*Some tests failed"
_flutter_failed = when(
    f"NOT {match('line', _flutter_all, 'All tests passed!')}",
    group_int("line", _flutter_some, 2, "Some tests failed"),
)
FLUTTER_TEST = RuleFamily(
    "flutter_test",
    {
        "fails": true_if(f"{_flutter_red} OR ({_flutter_failed}) IS NOT NULL"),
        "set_passed": (
            f"coalesce({group_int('line', _flutter_all, needs='All tests passed!')}, "
            f"{group_int('line', _flutter_some, needs='Some tests failed')})"
        ),
        "set_failed": _flutter_failed,
        "event": when(_flutter_red, "line"),
    },
    _by_tests((CROSS, " tests failed"), (CHECK, " tests passed"), "Flutter test completed"),
    "failed > 0",
    lambda c, a1, a2: f"({c} = 'flutter' AND {a1} = 'test')",
    any_of(
        has("line", "All tests passed!", "Some tests failed"),
        f"({has('line', 'Shell:')} AND {has('line', 'test')})",
    ),
    flags=(_flutter_red,),
)

_tsc_error = has("line", ": error TS")
TYPESCRIPT = RuleFamily(
    "typescript",
    {
        "fails": true_if(f"{_tsc_error} OR ({has('line', 'Found')} AND {has('line', 'error')})"),
        "add_errors": _tsc_error,
        "event": when(
            _tsc_error, _located(r"(.*?)\((\d+),(\d+)\): error (TS\d+): (.*)", "line")
        ),
    },
    f"if(errors > 0, {lit(CROSS + 'Type checking failed: ')}, {lit(CHECK + 'Type checking passed')})",
    by_command=lambda c, a1, a2: ends(c, "tsc"),
    separator="if(errors > 0, ' | ', NULL)",
    flags=(_tsc_error,),
)

DART = RuleFamily(
    "dart",
    {
        "fails": true_if(starts("line", "error ")),
        "add_errors": starts("line", "error "),
        "add_warnings": starts("line", "warning "),
        "event": when(starts("line", "info ", "error ", "warning "), "line"),
    },
    f"CASE WHEN errors > 0 THEN {lit(CROSS + 'Dart analyze failed with error')} "
    f"WHEN warnings > 0 THEN {lit(WARN + 'Dart analyze found warnings')} "
    f"ELSE {lit(CHECK + 'Dart analyze passed')} END",
    by_command=lambda c, a1, a2: f"({c} = 'dart' AND {a1} = 'analyze')",
    flags=(starts("line", "error "), starts("line", "warning ")),
)

# None of these words has a letter with a special case folding: lower case does as well.
_vite_sign = has("low", "error", "failed")
_vite_error = f"({_vite_sign} AND NOT {has('low', '0 failed', 'operation succeeded')})"
VITE = RuleFamily(
    "vite",
    {
        "fails": true_if(_vite_error),
        "add_errors": _vite_error,
        "add_warnings": f"NOT {_vite_sign} AND {has('low', 'warn')}",
        "set_modules": group_int("line", r".*?\s*(\d+)\s+modules\s+(?:transformed|compiled)", needs="modules"),
        "set_bundle": group("line", r"dist/.*?(\d+\.\d+\s*[KMG]B)", needs="dist/"),
        "event": when(_vite_error, "line"),
    },
    f"CASE WHEN bundle <> '' THEN concat({lit(CHECK + 'Build completed. Output: ')}, bundle, "
    "if(failure, ' (with non-fatal errors detected)', '')) "
    f"WHEN modules > 0 THEN concat({lit(CHECK + 'Build succeeded. ')}, modules, ' modules compiled') "
    f"WHEN failure THEN {lit(CROSS + 'Vite build failed')} "
    f"ELSE {lit(CHECK + 'Operation succeeded')} END",
    by_command=lambda c, a1, a2: any_of(
        f"{c} = 'vite'", _npm_script(c, a1, a2, "build", "dev")
    ),
    by_content=any_of(has("line", "[vite]"), has("low", "vite v")),
    event_cap=5,
    flags=(_vite_error, _vite_sign),
)

_low_error = has("low", "error", "failed")
BUILD_TOOL = RuleFamily(
    "buildtool",
    {
        **_red_lines(_low_error),
        "fails": (
            f"CASE WHEN {_low_error} THEN true "
            f"WHEN {has('low', 'compiled successfully', 'build successful')} THEN false END"
        ),
    },
    f"if(failure, concat({RED}, tool, ' build failed'), concat({lit(CHECK)}, tool, ' build successful'))",
    by_command=lambda c, a1, a2: has(c, *BUNDLERS),
    by_content=has("low", *BUNDLER_SIGNS),
    command_keywords=BUNDLERS,
    content_keywords=BUNDLER_SIGNS,
    event_cap=5,
    flags=(_low_error,),
)

_eslint_error = (
    f"(({has('line', ' error ')} OR {starts(TRIMMED, 'error ')}) AND NOT "
    f"{match('line', r'0\s+errors?')})"
)


def _counted(mark: str, name: str, noun: str) -> str:
    return when(f"{name} > 0", lit(mark), name, lit(f" {noun}"), f"if({name} > 1, 's', '')")


ESLINT = RuleFamily(
    "eslint",
    {
        "fails": true_if(_eslint_error),
        "add_errors": _eslint_error,
        "add_warnings": (
            f"NOT {_eslint_error} AND ({has('line', ' warning ')} OR {starts(TRIMMED, 'warning ')})"
        ),
        "event": when(_eslint_error, "line"),
    },
    f"if(errors > 0 OR warnings > 0, concat_ws('\\n', {_counted(CROSS, 'errors', 'error')}, "
    f"{_counted(WARN, 'warnings', 'warning')}), {lit(CHECK + 'No lint errors')})",
    by_command=lambda c, a1, a2: any_of(
        f"{c} = 'eslint'", f"({c} = 'npm' AND {a1} = 'run' AND {has(a2, 'lint')})"
    ),
    by_content=any_of(
        has("line", "eslint"),
        f"({has('line', 'error')} AND {has('line', 'warning')} AND {has('line', ':')})",
    ),
    flags=(_eslint_error,),
)

LINTER = RuleFamily(
    "linter",
    _red_lines(_low_error, WARN),
    f"if(errors > 0, concat({RED}, tool, ' found issues'), concat({lit(CHECK)}, tool, ' passed'))",
    by_command=lambda c, a1, a2: has(c, *FORMATTERS),
    command_keywords=FORMATTERS,
    event_cap=5,
    flags=(_low_error,),
)

_golangci_red = f"({has('line', ':')} AND {has('line', 'errcheck', 'unused', 'staticcheck')})"
GOLANGCI = RuleFamily(
    "golangci-lint",
    _red_lines(_golangci_red, WARN),
    f"if(errors > 0, {lit(CROSS + 'golangci-lint found issues')}, "
    f"{lit(CHECK + 'golangci-lint passed')})",
    by_command=lambda c, a1, a2: ends(c, "golangci-lint"),
    event_cap=5,
    flags=(_golangci_red,),
)

FLUTTER_BUILD = RuleFamily(
    "flutter_build",
    {
        "fails": true_if(has("line", "Exception: ", "Error:")),
        "set_artifact": group("line", r"Built\s+.*?\s+\((.*?)\)\.", needs="Built"),
        "event": when(has("line", "Exception: ", "Error:"), "line"),
    },
    f"CASE WHEN failure THEN {lit(CROSS + 'Flutter build failed')} WHEN artifact <> '' "
    f"THEN concat({lit(CHECK + 'Flutter build succeeded')}, '\\nAPK size ', artifact) "
    f"ELSE {lit(CHECK + 'Flutter build succeeded')} END",
    by_command=lambda c, a1, a2: f"({c} = 'flutter' AND {a1} = 'build')",
    flags=(has("line", "Exception: ", "Error:"),),
)

_flutter_run_red = (
    f"(NOT {has('line', 'Running with unset MSYS', 'Launching')} AND "
    f"{has('line', 'Error', 'Exception')})"
)
FLUTTER_RUN = RuleFamily(
    "flutter_run",
    _red_lines(_flutter_run_red),
    _by_failure(CROSS + "Flutter run failed", CHECK + "Flutter app is running"),
    by_command=lambda c, a1, a2: f"({c} = 'flutter' AND {a1} = 'run')",
    flags=(_flutter_run_red,),
)

_gradle_error = has("line", "error:", "e: ")
_gradle_task = f"if({starts('line', '> Task :')}, {extract('line', r'^> Task :(.*)')}, '')"
GRADLE = RuleFamily(
    "gradle",
    {
        "fails": true_if(
            any_of(
                starts("line", "FAILURE: Build failed"), has("line", "FAILED"), _gradle_error
            )
        ),
        "add_errors": _gradle_error,
        "event": when(has(_gradle_task, "compile", "assemble", "bundle"), lit("⚙ "), _gradle_task),
        "event2": when(_gradle_error, RED, TRIMMED),
    },
    _by_failure(CROSS + "Gradle build failed", CHECK + "Gradle build succeeded"),
    by_command=lambda c, a1, a2: has(c, "gradle"),
    event2_cap=10,
    flags=(_gradle_error,),
)

_net_error = has("line", ": error CS")
_net_totals = r"(\d+) Error\(s\).*?(\d+) Warning\(s\)"
DOTNET = RuleFamily(
    "dotnet",
    {
        "fails": true_if(_net_error),
        "add_errors": _net_error,
        "add_warnings": f"NOT {_net_error} AND {has('line', ': warning CS')}",
        "set_errors": group_int("line", _net_totals, 1, "Error(s)"),
        "set_warnings": group_int("line", _net_totals, 2, "Error(s)"),
        "event": when(
            _net_error,
            _located(r"(.*?)\((\d+),(\d+)\): error (CS\d+): (.*) \[(.*)\]", TRIMMED),
        ),
    },
    f"if(errors > 0, concat({lit(CROSS + '.NET build failed with ')}, errors, ' errors'), "
    f"{lit(CHECK + '.NET operation successful')})",
    "errors > 0",
    lambda c, a1, a2: any_of(has(c, "dotnet", "msbuild"), ends(c, "nuget")),
    flags=(_net_error,),
)

_migrated = has("low", "migrated", "migration successfully")
DB_MIGRATE = RuleFamily(
    "dbmigrate",
    {
        "fails": f"CASE WHEN {_low_error} THEN true WHEN {_migrated} THEN false END",
        "add_errors": _low_error,
        "event": (
            f"CASE WHEN {_low_error} THEN concat({RED}, {TRIMMED}) "
            f"WHEN {_migrated} THEN concat({lit('☑ ')}, {TRIMMED}) "
            f"WHEN {has('line', 'Applying migration', 'Running migration')} "
            f"THEN concat({lit('→ ')}, {TRIMMED}) END"
        ),
    },
    _by_failure(CROSS + "Migration failed", CHECK + "DB Migration finished"),
    by_command=lambda c, a1, a2: has(c, *MIGRATORS),
    command_keywords=MIGRATORS,
    flags=(_low_error, _migrated),
)

_npm_error = any_of(has("line", "ERR!"), has("low", "npm error"))
NPM = RuleFamily(
    "npm",
    {
        "fails": true_if(any_of(_npm_error, has("line", "failing"))),
        "add_errors": _npm_error,
        "add_warnings": (
            f"NOT {_npm_error} AND {any_of(has('line', 'WARN'), has('low', 'npm warn'))}"
        ),
        "add_failed": has("line", "failing"),
        "add_passed": f"NOT {has('line', 'failing')} AND {has('line', 'passing')}",
        "mark": f"{_npm_error} AND {has('low', 'missing script')}",
        "event": when(_npm_error, "line"),
    },
    f"CASE WHEN mark THEN {lit(CROSS + 'Missing script error')} "
    f"WHEN failure THEN {lit(CROSS + 'NPM execution failed')} "
    f"ELSE {lit(CHECK + 'NPM execution completed')} END",
    by_command=lambda c, a1, a2: ends(c, "npm"),
    by_content=any_of(has("low", "npm error"), has("line", "npm ERR!")),
    flags=(_npm_error, has("line", "failing")),
)

PNPM = RuleFamily(
    "pnpm",
    _red_lines(has("line", "ERR_PNPM_", "ERROR")),
    _by_failure(CROSS + "pnpm command failed", CHECK + "pnpm command successful"),
    by_command=lambda c, a1, a2: ends(c, "pnpm"),
    flags=(has("line", "ERR_PNPM_", "ERROR"),),
)

YARN = RuleFamily(
    "yarn",
    _red_lines(has("line", "error ", "ERROR")),
    _by_failure(CROSS + "yarn command failed", CHECK + "yarn command successful"),
    by_command=lambda c, a1, a2: ends(c, "yarn"),
    flags=(has("line", "error ", "ERROR"),),
)

_cargo_error = has("line", "error:", "error[")
_cargo_totals = (
    r"test result: (ok|FAILED)\. (\d+) passed; (\d+) failed; (\d+) ignored; (\d+) measured; "
    r"(\d+) filtered out; finished in ([\d\.]+)s"
)
_cargo_done = f"({starts('line', 'test result:')} AND {match('line', _cargo_totals)})"
CARGO = RuleFamily(
    "cargo",
    {
        "fails": (
            f"CASE WHEN {_cargo_done} THEN {extract('line', _cargo_totals, 1)} = 'FAILED' "
            f"WHEN {_cargo_error} THEN true END"
        ),
        "add_errors": _cargo_error,
        "add_warnings": f"NOT {_cargo_error} AND {has('line', 'warning:')}",
        "set_passed": when(_cargo_done, group_int("line", _cargo_totals, 2)),
        "set_failed": when(_cargo_done, group_int("line", _cargo_totals, 3)),
        "set_duration": when(
            _cargo_done,
            f"coalesce(try_cast({extract('line', _cargo_totals, 7)} AS DOUBLE), 0D)",
        ),
        "event": when(any_of(_cargo_error, has("line", "warning:")), "line"),
    },
    lit("Cargo command finished"),
    by_command=lambda c, a1, a2: ends(c, "cargo"),
    flags=(_cargo_error, _cargo_done),
)

_git_diffstat = r"(\d+) files? changed, (\d+) insertions?\(\+\), (\d+) deletions?\(-\)"
_git_modified = f"(argument = 'status' AND {starts('line', 'modified:')})"
GIT = RuleFamily(
    "git",
    {
        "add_warnings": _git_modified,
        "event": (
            f"CASE WHEN argument <> 'status' THEN NULL "
            f"WHEN {_git_modified} THEN concat({lit('☑ ')}, line) "
            f"WHEN {starts('line', 'new file:')} THEN concat({lit('✚ ')}, line) "
            f"WHEN {has('line', 'branch')} THEN concat({lit(chr(0xF418) + ' ')}, line) END"
        ),
        "event2": when(match("line", _git_diffstat, " changed, "), lit("⌛ "), "line"),
    },
    "if(events > 0, concat('Git ', argument, ' summary: '), "
    "concat('Git ', argument, ' execution finished.'))",
    by_command=lambda c, a1, a2: ends(c, "git", "git.exe"),
    separator="if(events > 0, ', ', NULL)",
    flags=(_git_modified,),
)

# The last resort has no rules of its own: see `summarize.semantic_summary`.
FALLBACK = RuleFamily("fallback")

# Order is precedence.
BUILT_IN: tuple[RuleFamily, ...] = (
    VITEST, JEST, PLAYWRIGHT, CYPRESS, PYTEST, GO_TEST, FLUTTER_TEST,
    TYPESCRIPT, DART,
    VITE, BUILD_TOOL, ESLINT, LINTER, GOLANGCI, FLUTTER_BUILD, FLUTTER_RUN, GRADLE, DOTNET,
    DB_MIGRATE,
    NPM, PNPM, YARN, CARGO, GIT,
)
BY_NAME = {family.name: family for family in BUILT_IN}


@dataclass(frozen=True)
class Extension:
    """Extra families (placed before the built-in ones) and extra suggestion rules."""

    name: str
    families: tuple[RuleFamily, ...] = ()
    suggestion_rules: tuple[tuple[str, str, str], ...] = ()


# The two shipped extensions, in registration order.
FLUTTER_EXTENSION = Extension(
    "flutter",
    (FLUTTER_BUILD, FLUTTER_TEST),
    (
        (
            "exception",
            r"(?i)MissingPluginException",
            "Run 'flutter clean' and 'flutter pub get' to rebuild generated plugin wrappers natively.",
        ),
    ),
)
VUE_EXTENSION = Extension(
    "vue",
    (VITE, VITEST),
    (
        (
            "lint_error",
            r"(?i)vue compiler macro",
            "Ensure you are using defineProps and defineEmits correctly inside <script setup> block natively.",
        ),
    ),
)
SHIPPED = (FLUTTER_EXTENSION, VUE_EXTENSION)


def extended_families(extensions: tuple[Extension, ...] = SHIPPED) -> tuple[RuleFamily, ...]:
    added = tuple(family for extension in extensions for family in extension.families)
    return added + BUILT_IN
