"""Session settings the engine relies on, and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # Daily and hourly buckets are UTC buckets.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Replaying one batch_id or month rewrites only that partition.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "cdcmart", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession, purpose: str, base: str | None = None) -> str:
    """A fresh folder that driver and executors share.

    Below ``base`` or the checkpoint directory the cluster names
    (``spark.checkpoint.dir``), else below the warehouse. A warehouse on the
    machine's own disk is refused unless the session itself is local.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/cdcmart/{purpose}-{uuid.uuid4().hex}"
