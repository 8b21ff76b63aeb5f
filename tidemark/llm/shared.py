"""What the corpus operators share: tables in the shared folder, row keys and clean column sets."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it.
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Lists that take note of the tables stored while they are open.
_NOTES: list[list[DataFrame]] = []


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that are stored within the block."""
    _NOTES.append(made := [])
    try:
        yield made
    finally:
        _NOTES.pop()


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every machine sees: ``spark.checkpoint.dir`` of the session.

    Only in a local session without the setting is a temporary folder made and set; on a cluster other
    machines would not see one, so there the missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the lineage.

    A lost executor costs no recomputation of what is stored.  The table goes when the JVM ends, or
    earlier by :func:`dropped`.
    """
    spark = session_of(df)
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    for made in _NOTES:
        made.append(out)
    return out


def collected(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done: it does so when the JVM collects them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        spark = session_of(df)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        where.getFileSystem(conf).delete(where, True)


def text_of(column: str | Column) -> Column:
    """The text, a null counting as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, with underscores before it until none of the tables has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
