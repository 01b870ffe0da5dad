"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "editloom", partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from the caller."""
    parts = partitions or (cpus if isinstance(cpus, int) else 8)
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(parts)).config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session may do without that setting; elsewhere executors could not see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        base = shared.rstrip("/")
    elif spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="editloom-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows evenly before a step that makes many rows out of each."""
    return df.repartition(*keys) if keys else df.repartition(df.sparkSession.sparkContext.defaultParallelism)
