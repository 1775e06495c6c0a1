"""Session builder used by tests, the bench and the command line.

Nothing here is needed when a session is handed in: every operator works with
the configuration it finds.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution and UTC time."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sidloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.warehouse.dir", "/tmp/sidloom-warehouse")
        .getOrCreate()
    )
