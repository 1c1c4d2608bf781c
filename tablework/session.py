"""Session set-up and the shared folder for checkpoints and stream output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tablework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster, leave ``master`` unset and let spark-submit give it; any
    setting passed by keyword (dots written as ``__``) wins over the defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only in a session whose executors are threads
    of the driver (master ``local``) does a temporary folder stand in for it; elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tablework-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
