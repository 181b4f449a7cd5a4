"""Log-shaped views over the given tables.

Every view reads a whole table. Where a view needs line numbers it ranks inside ranges of the
unique, increasing event id, so that a user with a large share of the events is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.functions.text import fields
from runsift.operators.blocks import number_rows
from workload import templates

EVENT_SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less time stamps become instants in the session time zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless}) if zoneless else df


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def template_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f"({ix}, {k}, {_quoted(line)})"
        for ix, _, lines in templates.tools()
        for k, line in enumerate(lines)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tool_ix, k, line)")


def command_of(tool_ix: Column) -> Column:
    commands = F.array(*[F.lit(command) for _, command, _ in templates.tools()])
    return F.element_at(commands, (tool_ix + 1).cast("int"))


def tool_ix(user: Column) -> Column:
    return F.pmod(user, F.lit(25)).cast("int")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exec_id, event_id, line: one template line per event."""
    user, event = F.col("user_id"), F.col("event_id")
    pick = F.pmod(event * 7 + user, F.lit(12))
    healthy = F.pmod(F.floor(user / 25), F.lit(2)) == 0
    k = F.when(
        healthy,
        F.when(pick < 6, F.pmod(event * 7 + user, F.lit(3))).otherwise(
            F.pmod(event * 7 + user, F.lit(4)) + 6
        ),
    ).otherwise(pick)
    events = table(spark, sf_dir, "events").select(
        user.alias("exec_id"), "event_id", tool_ix(user).alias("tool_ix"), k.cast("int").alias("k")
    )
    return events.join(F.broadcast(template_table(spark)), ["tool_ix", "k"]).select(
        "exec_id", "event_id", "line"
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = F.floor(F.col("event_id") / EVENT_SLICE)
    return number_rows(event_lines(spark, sf_dir), "exec_id", [sliced], ["event_id"]).select("exec_id", "line_no", "line")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runsift.sources.logs import split_log_blob

    return split_log_blob(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("exec_id"), "text")
    )


def pasted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exec_id, text: whole logs that come as one text, whose lines name tools. A document is one
    already; each of its lines gets the template line of its tool in front."""
    tool, text = F.pmod("doc_id", F.lit(25)).cast("int"), F.col("text")
    words = F.array(*[F.lit(lines[0] + " ") for _, _, lines in templates.tools()])
    prefix = F.element_at(words, tool + 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("exec_id"),
        F.concat(prefix, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), prefix))).alias("text"),
        # The exchange keeps the making of the texts out of the projections over their lines.
    ).repartition("exec_id")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("exec_id")
    base = command_of(tool_ix(user))
    last = F.pmod(user, F.lit(10))
    command_line = (
        F.when(last == 8, F.concat(F.lit("cd app && "), base))
        .when(last == 9, F.lit("sh ci.sh"))
        .when(last == 7, F.concat(base, F.lit(" | tee out.log")))
        .otherwise(base)
    )
    bad = (F.pmod(F.floor(user / 25), F.lit(2)) == 1) & (F.pmod(user, F.lit(2)) == 0)
    tokens = fields(F.col("command_line"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("exec_id"))
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .withColumn("command_line", command_line)
        .select(
            "exec_id",
            "command_line",
            F.element_at(tokens, 1).alias("cmd"),
            F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("args"),
            F.when(bad, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
            "start_ts",
            "end_ts",
        )
    )


def long_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few and long executions: one per event type, numbered by event id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("exec_id"),
        F.col("event_id").alias("line_no"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("line"),
    )


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("exec_id"),
        "ts",
        F.floor(F.col("value") * 1048576).cast("bigint").alias("rss_bytes"),
        F.pmod("event_id", F.lit(101)).cast("double").alias("cpu_pct"),
    )


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every execution changed the fixed paths but one, which one by its id."""
    paths = F.array(*[F.lit(p) for p in templates.CHANGED_PATHS])
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("exec_id"))
        .distinct()
        .select("exec_id", F.posexplode(paths).alias("_ix", "path"))
        .filter(F.col("_ix") != F.pmod("exec_id", F.lit(4)))
        .select("exec_id", "path")
    )


def vcs_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of captured version-control output per order."""
    key, kind = F.col("o_orderkey").cast("string"), F.pmod("o_orderkey", F.lit(6))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("exec_id"),
        F.when(kind < 2, F.lit("diff")).otherwise(F.lit("status")).alias("kind"),
        F.when(kind == 0, F.concat(F.lit(" src/f"), key, F.lit(".ts ")))
        .when(kind == 1, F.lit(""))
        .when(kind == 2, F.concat(F.lit(" M src/é"), key, F.lit(".ts")))
        .when(kind == 3, F.concat(F.lit("?? new"), key, F.lit(".txt")))
        .when(kind == 4, F.concat(F.lit("R  a"), key, F.lit(" -> b")))
        .otherwise(F.lit("?? "))
        .alias("line"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("execution_id"),
        command_of(tool_ix(F.col("o_custkey"))).alias("command"),
        F.when(F.col("o_orderstatus") == "F", F.lit("failure"))
        .otherwise(F.lit("success"))
        .alias("status"),
        F.col("o_orderpriority").alias("summary"),
        F.col("o_orderdate").alias("ts"),
    )


def history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History as JSON text: some lines are broken or of another shape, some lack a key or have an
    extra one."""
    key = F.pmod(F.col("execution_id").cast("bigint"), F.lit(20))
    full = F.to_json(F.struct("execution_id", "command", "status", "summary", F.lit(1).alias("n")))
    return history(spark, sf_dir).select(
        F.when(key == 0, F.lit('{"execution_id": "cut'))
        .when(key == 1, F.to_json(F.struct("execution_id", "command", "status")))
        .when(key == 2, F.lit('{"execution_id": 5}'))
        .when(key == 3, F.lit('{"command": {"x": 1}}'))
        .when(key == 4, F.concat(full, F.lit(" trailing")))
        .when(key == 5, F.concat(F.lit("["), full, F.lit("]")))
        .when(key == 6, F.lit("null"))
        .when(key == 7, F.concat(full, F.lit(","), full))
        .when(key == 8, F.concat(F.lit("  "), full, F.lit(" ")))
        .otherwise(full)
        .alias("value")
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct commands of the history, each alone and chained, plus fixed ones per status."""
    extra = F.array(*[F.lit(c) for c in templates.EXTRA_COMMANDS])
    past = history(spark, sf_dir).select("command", "status").distinct()
    variants = F.array(
        F.col("command"),
        F.concat("command", F.lit(" && git push ; "), "command"),
        F.concat(F.upper("command"), F.lit(" || echo done")),
    )
    return (
        past.select(F.explode(F.concat(variants, extra)).alias("command")).distinct()
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(
        *[F.lit(n) for n in ("pubspec.yaml", "vite.config.ts", "package.json", "README", "src/a.ts")]
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"),
        F.element_at(names, (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int")).alias("path"),
    )


def host_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("node", "npm", "pnpm", "flutter", "dart", "git", "vite")])
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("host"),
            F.element_at(names, (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("tool"),
        )
    )


def output_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two output streams per user; event time is the hour, so ties are common."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("exec_id"),
        "event_type",
        F.col("event_id").alias("seq"),
        F.date_trunc("hour", "ts").alias("ts"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("line"),
    )
    out = events.filter(F.col("event_type") != "error").withColumn("stream", F.lit("stdout"))
    err = events.filter(F.col("event_type") == "error").withColumn("stream", F.lit("stderr"))
    return out.unionByName(err).drop("event_type")
