"""Shared folders, row keys and small column helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table whose size was counted may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes up to which a table of rows of known size may be broadcast.
BROADCAST_BYTES = 64 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where none is named, a session of one machine gets one in its warehouse; on a cluster that is an error, as each
    machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    return stored_at(df, new_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint when a count shows at most `limit` rows; otherwise df as it is, joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def broadcast_within(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """df with a broadcast hint when a count shows that its rows, of row_bytes each at most, stay within limit; else None."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else None


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; lower() is quicker and the same where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


_held: dict = {}


def sole_holder(name: str, drop=lambda: None) -> None:
    """In a worker: `name` keeps tables from here on, and those of other operators that it ran before are dropped."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    _held[name] = drop
