"""A folder that driver and executors share, for intermediate tables and for what queries write before they read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names, `spark.checkpoint.dir`.

    Where that is unset (single-machine sessions, such as tests) it is set to a folder made for
    this process; on a cluster without it the warehouse folder is used.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path by which Python reaches a folder of a file system that all machines mount."""
    if "://" in folder.replace("file://", "") or folder.startswith(("hdfs:", "viewfs:", "s3")):
        raise ValueError(f"{folder} is not mounted")
    return folder.removeprefix("file://").removeprefix("file:")
