"""Written tables in the cluster's shared folder; see ``vertexloom.plans.workspace``."""

import gc

from pyspark.sql import SparkSession

from vertexloom.plans.workspace import Workspace, shared_folder, ship

__all__ = ["Workspace", "shared_folder", "ship", "tidy"]


def tidy(spark: SparkSession) -> None:
    """Let the driver notice which shuffles no plan needs any more, so that executors delete their files
    now and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
