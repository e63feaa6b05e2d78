"""Scratch folders for queries that write and read files again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, which executors share. Local runs may leave it unset: then in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_seqlattice_scratch", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="spark-scratch-")
            atexit.register(shutil.rmtree, root, True)
            spark.sparkContext._seqlattice_scratch = root
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Bytes that a Python worker gets at once.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that Spark hands to Python workers, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
