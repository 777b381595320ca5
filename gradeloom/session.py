"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the expressions rely on. They can be set on a session
# somebody else created, so `configure` is all a caller with a session needs.
RUNTIME_CONF = {
    # JSON objects with a repeated key parse, and the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans here are built from many small expressions; recording the call site of
    # each one more than doubles the time that takes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A second attempt of a running task would repeat paid model calls.
    "spark.speculation": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets the runtime settings on an existing session and returns it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "gradeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is meant to run with."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share.

    The cluster names that folder in `spark.checkpoint.dir`. Only a local-mode
    session (tests) may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="gradeloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
