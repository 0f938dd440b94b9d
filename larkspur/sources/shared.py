"""Tables written in between, in the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Shared:
    """A folder below spark.checkpoint.dir whose tables cut lineage: after a loss they are read again, not computed again.

    Only a local session may do without that setting; it gets a folder of its own. The folder goes with `drop`,
    or when the driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # at exit the session may be gone
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        atexit.unregister(self.drop)
