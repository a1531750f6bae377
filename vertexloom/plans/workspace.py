"""Tables in the shared folder that the cluster names, to cut lineage where a plan is used twice."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_vertexloom_shipped", False):
        return
    package = Path(__file__).parent.parent
    path = Path(tempfile.mkdtemp(prefix="vertexloom-")) / "vertexloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(path))  # the driver serves it to the executors
    sc._vertexloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, but only if driver and
    executors are one process (local master), as in tests: no other executor could read it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vertexloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, partition by partition, and read back from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Workspace:
    """Written tables of one run, below a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: a lost executor costs a read, not the stages before."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
