"""Project type from a file listing, and which tools a host has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
TOOLS = ("node", "npm", "pnpm", "flutter", "dart", "git", "vite")
VITE_CONFIGS = ("vite.config.js", "vite.config.ts")


def project_type(listing: DataFrame) -> DataFrame:
    """project, project_type and whether vite is configured."""
    return (
        listing.groupBy("project")
        .agg(
            F.bool_or(F.col("path") == "pubspec.yaml").alias("_flutter"),
            F.bool_or(F.col("path").isin(*VITE_CONFIGS)).alias("_vite"),
            F.bool_or(F.col("path") == "package.json").alias("_node"),
        )
        .select(
            "project",
            F.when(F.col("_flutter"), F.lit("Flutter"))
            .when(F.col("_vite"), F.lit("Vue (Vite)"))
            .when(F.col("_node"), F.lit("Node.js (Standard)"))
            .otherwise(F.lit("Unknown Environment"))
            .alias("project_type"),
            (~F.col("_flutter") & F.col("_vite")).alias("vite_detected"),
        )
    )


def tool_matrix(host_tools: DataFrame, project_types: DataFrame | None = None) -> DataFrame:
    """One row per host with `installed` / `not found` per tool. With project types (project =
    host), a configured vite shows as `detected`, which takes precedence over `installed`."""
    matrix = host_tools.groupBy("host").agg(
        *[
            F.when(F.bool_or(F.col("tool") == tool), F.lit("installed"))
            .otherwise(F.lit("not found"))
            .alias(tool)
            for tool in TOOLS
        ]
    )
    if project_types is None:
        return matrix
    detected = project_types.filter("vite_detected").select(
        F.col("project").alias("host"), F.lit("detected").alias("_vite")
    )
    return (
        matrix.join(detected, "host", "left")
        .withColumn("vite", F.coalesce("_vite", "vite"))
        .drop("_vite")
    )
