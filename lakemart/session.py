"""Session settings the package is written for, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

# A JSON object with a key twice keeps the last value instead of being refused.
# Adaptive execution re-plans joins from measured sizes and splits hot join
# partitions; the forced variant also splits when a later step reuses the keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def get_session(app_name: str = "lakemart", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with :data:`SETTINGS`; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="lakemart-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    Only a local session may fall back to a folder of this machine: on a cluster
    the executors would each see their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = _local_scratch()
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
