"""runsift: command-log analytics as Spark DataFrame jobs."""
