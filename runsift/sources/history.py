"""History as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.sources.batches import published

FIELDS = ("execution_id", "command", "status", "summary")


def parse_history(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries from JSON text in a column. A line counts if the whole of it is one JSON value, an
    object or null, and each known field is a string or null; missing fields are ''."""
    kept = [c for c in lines.columns if c != column]
    # An element behind the value, if the value is the whole text, and a broken text if not.
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]")))
    # "1, 2" would pass as two elements.
    value = F.try_variant_get(whole, "$[0]", "variant")
    second = F.try_variant_get(whole, "$[1]", "variant")
    kind = F.schema_of_variant("_v")
    # A generator, so that the parsing is not repeated in each of the expressions above it.
    once = F.inline(F.array(F.struct(value.alias("_v"), second.alias("_w"))))
    parts = lines.select(*kept, once).filter(F.col("_v").isNotNull() & F.col("_w").isNull())
    good = kind.startswith("OBJECT") | (kind == "VOID")
    fields = []
    for name in FIELDS:
        each = F.try_variant_get("_v", f"$.{name}", "variant")
        good = good & (each.isNull() | F.schema_of_variant(each).isin("STRING", "VOID"))
        fields.append(F.coalesce(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")).alias(name))
    return parts.filter(good).select(*kept, *fields)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the published batches at a path, one JSON value per line."""
    folders = published(spark, path)
    if not folders:
        return spark.createDataFrame([], ", ".join(f"{name} string" for name in FIELDS))
    return parse_history(spark.read.text(folders))


def read_history_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all files below a path, as another program has written them."""
    return parse_history(spark.read.text(path))
