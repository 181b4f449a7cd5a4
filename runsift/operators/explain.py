"""What a command does, from an ordered rule ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.text import contains_any, trim

# Fixed values: (words any of which selects the rule, type, tool, description), in order.
LADDER = (
    (("vue-tsc", "tsc"), "typecheck", "typescript", "Performs static type checking on the codebase to ensure type safety."),
    (("npm run build", "vite build"), "build", "vite", "Compiles the application for production. In modern Vue projects, this typically uses Vite/Rollup to bundle assets."),
    (("npm run dev", "npm start"), "dev", "vite", "Starts the development server with hot module replacement (HMR)."),
    (("npx ",), "exec", "npx", "Executes a package-based command without having to install it globally."),
    (("npm run test", "npm test"), "test", "npm", "Executes the test suite defined in package.json."),
    (("npm install", "npm i"), "install", "npm", "Installs project dependencies defined in package.json."),
    (("flutter build",), "build", "flutter", "Builds the Flutter application for the target platform."),
    (("flutter test",), "test", "flutter", "Runs unit or widget tests for the Flutter project."),
)
COVERAGE = "Runs Vitest tests and generates a code coverage report to see how much of the code is tested."
VITEST = "Executes unit and widget tests using the Vitest test runner, highly optimized for Vite-based projects."
GIT = "A version control command to manage source code history."
UNKNOWN = "Unknown command"
CHAIN_HEADER = "This is a chained command execution:\n\n"
SEPARATORS = (" && ", " ; ", " || ")


def _row(kind: str, tool: str, description: str) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(tool).alias("tool"), F.lit(description).alias("description")
    )


def explain_single(command: Column) -> Column:
    """struct(type, tool, description) of one command."""
    low = F.lower(command)
    out = F.when(low.startswith("git "), _row("vcs", "git", GIT)).otherwise(
        _row("unknown", "unknown", UNKNOWN)
    )
    for words, kind, tool, description in reversed(LADDER):
        condition = contains_any(low, *words)
        if kind == "dev":
            condition = condition | (low.contains("vite") & ~low.contains("build"))
        out = F.when(condition, _row(kind, tool, description)).otherwise(out)
    vitest = F.when(low.contains("--coverage"), _row("test", "vitest", COVERAGE)).otherwise(
        _row("test", "vitest", VITEST)
    )
    return F.when(low.contains("vitest"), vitest).otherwise(out)


def is_chain(command: Column) -> Column:
    return contains_any(command, *SEPARATORS)


def _splitter(pattern: str) -> Callable[[Column], Column]:
    return lambda part: F.split(part, pattern, -1)


def chain_description(command: Column) -> Column:
    """Numbered descriptions of the parts; blank parts count but are not shown."""
    parts = F.array(command)
    for separator in SEPARATORS:
        parts = F.flatten(F.transform(parts, _splitter(rf"\Q{separator}\E")))
    shown = F.transform(
        parts,
        lambda p, i: F.when(
            trim(p) != "",
            F.concat(
                (i + 1).cast("string"),
                F.lit(". **"),
                trim(p),
                F.lit("**: "),
                explain_single(trim(p)).getField("description"),
            ),
        ),
    )
    return F.concat(F.lit(CHAIN_HEADER), F.array_join(F.array_compact(shown), "\n\n"))


def explain_commands(commands: DataFrame) -> DataFrame:
    """command, type, tool, description for single and chained commands. Row-local."""
    command = trim(F.col("command"))
    single = explain_single(F.col("command"))
    chained = is_chain(F.col("command"))
    return (
        commands.select(command.alias("command"))
        .select(
            "command",
            F.when(
                chained,
                F.struct(
                    F.lit("composite").alias("type"),
                    F.lit("multitool").alias("tool"),
                    chain_description(F.col("command")).alias("description"),
                ),
            )
            .otherwise(single)
            .alias("_e"),
        )
        .select("command", "_e.type", "_e.tool", "_e.description")
    )


def explain_distinct(commands: DataFrame) -> DataFrame:
    """Explanations of the distinct commands of a table: each is explained once."""
    return explain_commands(commands.select("command").distinct())


def headline(explained: DataFrame) -> DataFrame:
    return explained.select(
        "command", F.split_part("description", F.lit("\n"), F.lit(1)).alias("headline")
    )
