"""Log sources: blobs, log directories, merged streams, changed-file listings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsift.functions.text import trim
from runsift.operators.blocks import EXEC, LINE_NO, number_rows
from runsift.session import as_table
from runsift.sources import sinks


def split_log_blob(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Lines of a whole-log column, numbered from 0; empty lines are kept."""
    return blobs.select(EXEC, F.posexplode(F.split(text, "\n", -1)).alias(LINE_NO, "line")).select(
        EXEC, F.col(LINE_NO).cast("bigint").alias(LINE_NO), "line"
    )


#: Ranges of files whose line counts may be sent to all executors; beyond, lines move to meet them.
SENT_RANGES = 200_000


#: Files up to this size are rows of their own: opening one for its lines costs more than reading it.
WHOLE_BYTES = 1 << 20
#: Files that the driver may hold.
DRIVER_FILES = 100_000
#: Bytes that a task reads, where a file counts FILE_COST more, and bytes that go to Spark together.
TASK_BYTES, FILE_COST, BATCH_BYTES = 64 << 20, 16 << 10, 4 << 20


def read_log_dir(spark: SparkSession, path: str, name_filter: str = "*.log") -> DataFrame:
    """Lines of a directory with one file per execution: `<exec_id>.log`, or any file name in a
    folder `exec_id=<id>`.

    Small files are read whole, once, and split at their line feeds, so that many of them cost one
    opening each. Any other file is read in byte ranges, each by a task of its own. Lines are numbered
    in their range; the ranges of a file are counted, and each is shifted by the lines before it. A
    line belongs to the range in which it begins. Only line feeds end lines; one at the end of the
    file opens no further line, and an empty file has none. A byte order mark at the beginning of a
    file is left out.

    Folders are listed by tasks. Spark's readers keep all files in the driver, so more than
    DRIVER_FILES are rows instead, which tasks open themselves. Of a file system that only Spark
    knows, and of a path that stands for several, Spark lists the files whatever their number.
    """
    # What the session would split is not read whole.
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    whole = min(WHOLE_BYTES, split)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    try:
        files, top = sinks._files_at(uri)
        listable = not set("{}[]*?\\") & set(path) and files.get_file_info(top).type == FileType.Directory
    except (pa.ArrowException, OSError):
        listable = False
    found = _listed(spark, uri, top, name_filter) if listable else None
    if found is None or found.count() <= DRIVER_FILES:
        return _read_by_spark(spark, path, name_filter, whole)
    small, large = found.where(F.col("size") <= whole), found.where(F.col("size") > whole)
    count, size, most = found.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(((size or 0) + count * FILE_COST) / TASK_BYTES))
    lines = _whole_lines(small.repartition(min(tasks, max(count, 1))).mapInArrow(_reads_whole(uri), "_path string, content binary"))
    if (most or 0) <= whole:
        return lines
    cut = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))
    ranges = large.select("path", F.explode(cut).alias("start"), (F.col("start") + F.lit(split)).alias("end"))
    rows = ranges.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / split))).mapInArrow(
        _reads_ranges(uri), "_path string, _start bigint, _id bigint, line binary"
    )
    return lines.unionByName(_numbered_ranges(rows.withColumn("line", F.col("line").cast("string"))))


def _listed(spark: SparkSession, uri: str, top: str, name_filter: str) -> DataFrame:
    """path and size of the files below a folder, at any depth, whose names fit the filter. Hidden
    files and folders are left out as Spark does. One pass lists all folders of a depth."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = sinks._files_at(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                infos = files.get_file_info(FileSelector(folder))
                for at in range(0, len(infos), 10_000):
                    some = infos[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x.path for x in some], pa.string()),
                            pa.array([x.base_name for x in some], pa.string()),
                            pa.array([x.size for x in some], pa.int64()),
                            pa.array([x.type == FileType.Directory for x in some], pa.bool_()),
                        ],
                        names=["path", "name", "size", "folder"],
                    )

    hidden = F.expr("(startswith(name, '_') AND NOT contains(name, '=')) OR startswith(name, '.') OR endswith(name, '._COPYING_')")
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern(name_filter).compiled().pattern()
    folders, found = spark.createDataFrame([(top,)], "path string"), None
    while folders is not None:
        here = as_table(folders.mapInArrow(listing, "path string, name string, size bigint, folder boolean").where(~hidden), "listing")
        fits = here.where(~F.col("folder") & F.col("name").rlike(rf"(?s)\A(?:{wanted})\z")).select("path", "size")
        found = fits if found is None else found.unionByName(fits)
        deeper = here.where("folder").select("path")
        count = deeper.count()
        folders = deeper.repartition(min(count, 8 * spark.sparkContext.defaultParallelism)) if count else None
    return found


def _encoded(path: str) -> str:
    """A path as Spark's readers give it to `_exec_id`, which decodes it."""
    return path.replace("%", "%25")


def _reads_whole(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = sinks._files_at(uri)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["_path", "content"])

        paths, contents, size = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as file:
                    contents.append(file.read())
                paths.append(_encoded(path))
                size += len(contents[-1])
                if size >= BATCH_BYTES or len(paths) >= 10_000:
                    yield out()
                    paths, contents, size = [], [], 0
        if paths:
            yield out()

    return read


def _reads_ranges(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines that begin in ranges of files, numbered in their range. A piece of BATCH_BYTES, and the
    line that goes on from it, is held at a time."""

    def pieces(files, path: str, start: int, end: int) -> Iterator[list[bytes]]:
        with files.open_input_file(path) as file:
            # From the byte before: what stands up to the first line feed began in an earlier range.
            at, skipping = max(start - 1, 0), start > 0
            file.seek(at)
            # Pieces of the line that goes on; `at` is where the next piece begins.
            held = []
            while at < end or held:
                piece = file.read(BATCH_BYTES)
                if not piece:
                    break
                if at == 0 and piece.startswith(b"\xef\xbb\xbf") and not start:
                    at, piece = 3, piece[3:]
                if skipping:
                    feed = piece.find(b"\n") + 1
                    at += feed or len(piece)
                    if not feed:
                        continue
                    piece, skipping = piece[feed:], False
                    if at >= end:
                        return
                # Nothing behind the line that holds the last byte of the range.
                feed = piece.find(b"\n", max(end - 1 - at, 0)) + 1 if at + len(piece) >= end else 0
                *lines, rest = piece[: feed or len(piece)].split(b"\n")
                if lines:
                    lines[0] = b"".join([*held, lines[0]])
                    held = []
                    yield lines
                if feed:
                    return
                held += [rest] if rest else []
                at += len(piece)
            if held:
                yield [b"".join(held)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = sinks._files_at(uri)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                number = 0
                for lines in pieces(files, path, start, end):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([_encoded(path)] * n, pa.string()),
                            pa.array([start] * n, pa.int64()),
                            pa.array(range(number, number + n), pa.int64()),
                            pa.array(lines, pa.binary()),
                        ],
                        names=["_path", "_start", "_id", "line"],
                    )
                    number += n

    return read


def _read_by_spark(spark: SparkSession, path: str, name_filter: str, whole: int) -> DataFrame:
    options = {"pathGlobFilter": name_filter, "recursiveFileLookup": True}
    size = F.col("_metadata.file_size")
    files = spark.read.format("binaryFile").load(path, **options)
    lines = _whole_lines(files.where(size <= whole).select(F.col("_metadata.file_path").alias("_path"), "content"))
    # Files are left out by their size when the scan is planned; none is opened for this.
    if files.where(size > whole).select("path").isEmpty():
        return lines
    large = spark.read.option("lineSep", "\n").text(path, **options).where(size > whole)
    # Ids of rows increase by one inside a range, whichever ranges a task reads one after the other.
    rows = large.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    return lines.unionByName(_numbered_ranges(rows))


def _exec_id(path: str) -> Column:
    folder = r"/exec_id=([^/]+)/[^/]*\z"
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.col(path).rlike(folder), F.url_decode(F.regexp_extract(path, folder, 1))).otherwise(
        F.url_decode(F.regexp_replace(name, r"\.log\z", ""))
    )


def _whole_lines(files: DataFrame) -> DataFrame:
    """Lines of files that are read whole (_path, content). Every byte is a letter here, as in ISO 8859-1: ill-formed
    text must come out as it is."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\A\xEF\xBB\xBF", "")
    pieces = F.transform(
        F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1), lambda piece: F.encode(piece, "ISO-8859-1").cast("string")
    )
    return (
        files.select("_path", F.posexplode(F.when(text != "", pieces)).alias(LINE_NO, "line"))
        .select(_exec_id("_path").alias(EXEC), F.col(LINE_NO).cast("bigint").alias(LINE_NO), "line")
    )


def _numbered_ranges(rows: DataFrame) -> DataFrame:
    """Lines of files that are read in byte ranges (_path, _start, _id, line); `_id` increases by one
    inside a range."""
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("_path", "_start")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("_path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    ranges = as_table(ranges, "ranges")
    if ranges.count() <= SENT_RANGES:
        ranges = F.broadcast(ranges)
    return rows.join(ranges, ["_path", "_start"]).select(
        _exec_id("_path").alias(EXEC), (F.col("_id") + F.col("_shift")).alias(LINE_NO), "line"
    )


SEQ_SLICE = 1 << 16


def merge_streams(lines: DataFrame) -> DataFrame:
    """Merge the output streams of an execution: event time, then sequence, then stream name.
    `lines` has exec_id, stream, seq, ts, line.

    Sorted are only the lines of one execution with one time stamp and nearby sequence numbers.
    """
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    within = F.struct("ts", F.call_function("div", "seq", F.lit(SEQ_SLICE)).alias("seq_slice"))
    return number_rows(lines, EXEC, [second, within], ["ts", "seq", "stream"], LINE_NO)


def changed_files(output: DataFrame) -> DataFrame:
    """Changed paths from captured version-control output (exec_id, kind, line).

    `kind` is `diff` for name-only listings and `status` for porcelain status lines, whose path
    starts at the fourth byte. Repeats are kept.
    """
    line = F.col("line")
    path = F.when(F.col("kind") == "diff", trim(line)).when(
        F.octet_length(line) > 3, trim(_from_byte(line, 4))
    )
    return output.select(EXEC, path.alias("path")).filter(F.col("path") != "")


def _from_byte(text: Column, position: int) -> Column:
    raw = F.substring(text.cast("binary"), position, 1 << 30)
    return F.decode(raw, "UTF-8")
