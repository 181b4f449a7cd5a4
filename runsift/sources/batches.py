"""Appends that can be repeated: every write is a batch with an id and counts once.

A batch is written to a folder of its own and published by one marker file, which names it. Readers
read the folders that markers name. A write that died half-way has no marker and may run again; one
that runs again after it was published finds the marker and adds nothing. Of two at the same time one
is named in the end.

    <path>/parts/<batch>-<attempt>/...    data
    <path>/batches/<batch>                one line: <batch>-<attempt>
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the session's Hadoop client has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def publish(df: DataFrame, path: str, batch: str, write: Callable[[DataFrame, str], None]) -> bool:
    """Write df with write(df, folder) as batch `batch` of the table at `path`. False, and nothing
    is added, if that batch is there already."""
    spark, name = df.sparkSession, quote(batch, safe="")
    fs, marker = _folder(spark, f"{path}/batches/{name}")
    if fs.exists(marker):
        return False
    attempt = f"{name}-{uuid.uuid4().hex}"
    write(df, f"{path}/parts/{attempt}")
    # The marker appears with its line, or not at all; hidden files are no markers.
    _, waiting = _folder(spark, f"{path}/batches/_{attempt}")
    out = fs.create(waiting, True)
    out.write(attempt.encode())
    out.close()
    if not fs.exists(marker) and fs.rename(waiting, marker):
        return True
    fs.delete(waiting, False)
    return False


def published(spark: SparkSession, path: str) -> list[str]:
    """The folders of published batches, one for each write; the batches are the bound."""
    fs, place = _folder(spark, f"{path}/batches")
    if not fs.exists(place) or not len(fs.listStatus(place)):
        return []
    names = spark.read.text(f"{path}/batches", wholetext=True).collect()
    return sorted(f"{path}/parts/{row['value']}" for row in names)
