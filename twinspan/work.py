"""Tables written between the steps of iterative operators.

Written tables cut lineage, survive the loss of executors and give the optimizer real sizes to choose joins by.
They live in the shared folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new temporary one, in a local session only, as executors
    elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="twinspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Named tables of one run of an operator, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/twinspan/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df as Parquet and return the written table."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Have the driver collect its garbage, so that executors delete shuffle files of steps whose results are written.

        Else those files stay until the driver happens to need memory, and all steps' shuffles take disk at once.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        jvm = self.spark._jvm
        for table in tables:
            for file in table.inputFiles()[:1]:
                folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
