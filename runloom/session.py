"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"


def build_session(app: str = "runloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew-join splitting)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder.

    The folder is the one named by ``spark.checkpoint.dir``, else one below the session's warehouse. A warehouse on a local
    disk is refused unless the session runs on one machine, as executors elsewhere would not see it.
    """
    root = spark.conf.get(CHECKPOINT_DIR_KEY, None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        on_disk = warehouse.startswith(("file:", "/"))
        if on_disk and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR_KEY} to a folder that all executors reach; {warehouse} is on one machine's disk")
        root = f"{warehouse}/_work"
    return f"{root.rstrip('/')}/runloom/{label}-{uuid.uuid4().hex}"
