"""Session defaults. Values already set on a running session always win."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``master`` is only for tests and benches."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def default(spark: SparkSession, key: str, value: str) -> None:
    """Set ``key`` on a running session that has no value of its own for it."""
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, value)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Set ``key`` for a while, where the session has no value of its own for it."""
    own = spark.conf.get(key, None) is not None
    if not own:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(key)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, a master with one
    process (tests) gets a temporary folder, and the setting is filled in with
    it; any other master is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}") if "://" not in root else f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
