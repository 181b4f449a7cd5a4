"""Sinks: cleaned logs with a manifest, history, summaries routed by artifact name.

Logs, history and summaries are tables of batches (`runsift.sources.batches`): a write that runs
again adds nothing.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.operators.blocks import EXEC, LINE_NO
from runsift.sources.batches import publish, published
from runsift.sources.history import FIELDS

# Tools whose summary has a name of its own.
ARTIFACT_NAMES = {
    "execution_summary.json": ("fallback", ""),
    "test_results.json": ("gotest", "pytest", "jest"),
    "build_summary.json": ("cargo",),
}
ARTIFACT_DIR = "artifacts"


def artifact_name(tool: Column) -> Column:
    out = F.concat(tool, F.lit("_summary.json"))
    for name, tools in ARTIFACT_NAMES.items():
        out = F.when(tool.isin(*tools), F.lit(name)).otherwise(out)
    return out


def artifact_path(exec_id: str) -> str:
    """SQL of the path of an execution's cleaned log."""
    return f"concat('{ARTIFACT_DIR}/', {exec_id}, '.log')"


#: Folders over which the files of a log directory are spread, so that they can be listed in parallel.
FOLDERS = 256


#: Letters that the names of partition folders have as %XX.
SPECIAL = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
#: What partition folders have for a missing or empty value.
NONE = "__HIVE_DEFAULT_PARTITION__"


def _files_at(uri: str) -> tuple[FileSystem, str]:
    """The file system of a place as Python has it, and the path there."""
    return FileSystem.from_uri(f"file:///{uri[5:].lstrip('/')}" if uri.startswith("file:") else uri)


def write_log_dir(logs: DataFrame, path: str) -> None:
    """Write each log (exec_id, text) as a file `<exec_id>.log`, for `read_log_dir`; the texts of an
    execution with several rows stand in one file, each with a line feed behind it.

    Tasks write their files directly: the commit of a table would move each of them once more, in the
    driver. A file appears whole, and one that is written again is the same."""
    spark = logs.sparkSession
    rows = logs.select(F.coalesce(F.nullif(F.col(EXEC).cast("string"), F.lit("")), F.lit(NONE)).alias(EXEC), "text")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    try:
        _files_at(uri)
    except (pa.ArrowException, OSError):
        # A file system that only Spark knows: a folder for each execution.
        rows.repartition(EXEC).write.partitionBy(EXEC).option("lineSep", "\n").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _files_at(uri)
        folders, of, out, written = set(), None, None, 0

        def places(name: str) -> tuple[str, str]:
            folder = f"{top}/{zlib.crc32(name.encode()) % spread:03d}"
            if folder not in folders:
                files.create_dir(folder)
                folders.add(folder)
            plain = SPECIAL.sub(lambda letter: f"%{ord(letter[0]):02X}", name)
            if plain[0] in "_.":  # files of such names are hidden
                folder = f"{folder}/exec_id={plain}"
                files.create_dir(folder)
                plain = "log"
            return f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{plain}.log"

        def close() -> None:
            if out is not None:
                out.close()
                files.move(waiting, place)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != of:
                    close()
                    of, (waiting, place) = name, places(name)
                    out = files.open_output_stream(waiting)
                    written += 1
                out.write((text or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    parts, spread = int(spark.conf.get("spark.sql.shuffle.partitions")), FOLDERS
    apart = rows.select(EXEC, F.col("text").cast("binary").alias("text")).repartition(parts, EXEC).sortWithinPartitions(EXEC)
    apart.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


#: Files that are opened one by one for the logs of some records; beyond, the table is scanned.
MOST_FILES = 10_000
#: Rows of the manifest that may be sent to all executors; beyond, lines move to meet them.
SENT_NAMES = 50_000

LOG_SCHEMA = "line_no bigint, line string, exec_date date"


def write_clean_logs(cleaned: DataFrame, path: str, date: Column, batch: str) -> bool:
    """Write cleaned lines by day, and a manifest of what stands where. Rows are ranged by (day,
    exec_id, line_no): an execution of any size spreads over files, and a file holds consecutive
    lines of it.

    The manifest has a row for each file of an execution: raw_log_path (the name that records
    give the log), exec_id, file, first_line, last_line, lines. It is ordered by name, so that a
    look-up reads few of its row groups."""

    def write(df: DataFrame, folder: str) -> None:
        spark = df.sparkSession
        (
            df.repartitionByRange("exec_date", EXEC, LINE_NO)
            .sortWithinPartitions("exec_date", EXEC, LINE_NO)
            .write.partitionBy("exec_date")
            .parquet(f"{folder}/logs")
        )
        kind = df.schema[EXEC].dataType.simpleString()
        lines = spark.read.schema(f"{EXEC} {kind}, {LOG_SCHEMA}").parquet(f"{folder}/logs")
        # Two narrow columns are read again.
        files = (
            lines.select(EXEC, LINE_NO, F.col("_metadata.file_path").alias("file"))
            .groupBy(EXEC, "file")
            .agg(F.min(LINE_NO).alias("first_line"), F.max(LINE_NO).alias("last_line"), F.count(F.lit(1)).alias("lines"))
        )
        named = files.select(F.expr(artifact_path(EXEC)).alias("raw_log_path"), *files.columns)
        named.repartitionByRange("raw_log_path").sortWithinPartitions("raw_log_path").write.parquet(f"{folder}/manifest")

    return publish(cleaned.withColumn("exec_date", date).select(EXEC, LINE_NO, "line", "exec_date"), path, batch, write)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    folders = [f"{folder}/manifest" for folder in published(spark, path)]
    if not folders:
        raise FileNotFoundError(f"no logs at {path}")
    return spark.read.parquet(*folders)


def read_clean_logs(spark: SparkSession, path: str, raw_log_paths: DataFrame) -> DataFrame:
    """raw_log_path, exec_id, line_no, line: the logs that records name in `raw_log_path`.

    Only the files that the manifest lists for them are opened, unless there are very many. Lines
    are never sent to all executors: their compressed files tell nothing of their size."""
    wanted = raw_log_paths.select("raw_log_path").where("raw_log_path is not null").distinct()
    found = read_manifest(spark, path).hint("merge").join(wanted, "raw_log_path")
    kind = found.schema[EXEC].dataType.simpleString()
    schema = f"{EXEC} {kind}, {LOG_SCHEMA}"
    files = [row["file"] for row in found.select("file").distinct().limit(MOST_FILES + 1).collect()]
    if not files:
        return spark.createDataFrame([], f"raw_log_path string, {EXEC} {kind}, line_no bigint, line string")
    names = found.select(F.col(EXEC).alias("_exec"), F.col("file").alias("_file"), "raw_log_path")
    names = names.hint("broadcast" if names.count() <= SENT_NAMES else "merge")
    # Whole batches by their folder, so that the days come back as a column.
    sets = [files] if len(files) <= MOST_FILES else [[f"{folder}/logs"] for folder in published(spark, path)]
    out = None
    for some in sets:
        lines = spark.read.schema(schema).parquet(*some)
        here = lines.select(EXEC, LINE_NO, "line", F.col("_metadata.file_path").alias("_at"))
        part = here.join(names, (F.col(EXEC) == F.col("_exec")) & (F.col("_at") == F.col("_file"))).select(
            "raw_log_path", EXEC, LINE_NO, "line"
        )
        out = part if out is None else out.unionByName(part)
    return out


def append_history(summaries: DataFrame, path: str, batch: str) -> bool:
    """Append {execution_id, command, status, summary} as JSON lines."""
    return publish(summaries.select(*FIELDS), path, batch, lambda df, folder: df.write.json(folder))


def write_summaries(summaries: DataFrame, path: str, batch: str) -> bool:
    """Write summaries as JSON under `artifact_name=<name>`; `summaries` has the tool."""
    named = summaries.withColumn("artifact_name", artifact_name(F.col("tool")))
    return publish(named, path, batch, lambda df, folder: df.write.partitionBy("artifact_name").json(folder))


def read_summaries(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """Summaries with their artifact_name; with `name`, only that artifact's files are read."""
    out = None
    for folder in published(spark, path):
        part = spark.read.schema(f"{schema}, artifact_name string").json(folder)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{schema}, artifact_name string")
    return out if name is None else out.where(F.col("artifact_name") == name)
