"""Session defaults for tests, the benchmark and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "vantle", cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster the submitter's settings win."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
