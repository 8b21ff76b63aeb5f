"""Tables in the folder that all machines see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``, which goes when the JVM ends; in a local session without one, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster see")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(rows: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """The rows, written and read again: their lineage ends, and what was persisted for them is released."""
    out = new_folder(rows.sparkSession)
    rows.write.parquet(out)
    while held:
        held.pop().unpersist()
    return rows.sparkSession.read.schema(rows.schema).parquet(out)
