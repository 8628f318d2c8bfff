"""A local session for tests, the bench and trying things out."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    os.environ.setdefault("PYTHONHASHSEED", "0")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuskiln")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", "-Djava.io.tmpdir=/tmp")
        .getOrCreate()
    )
