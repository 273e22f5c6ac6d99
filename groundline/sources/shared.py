"""Tables that a plan writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a temporary folder is made in local mode, and refused on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='groundline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """A folder of its own for one run. Its tables cut lineage: a lost executor takes nothing with it.

    ``release`` deletes the folder; else it goes when the driver ends, since a returned
    DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.release)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already when the driver ends
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
