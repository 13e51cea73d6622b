"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``stored`` wrote in this process and ``scratch`` hasn't dropped.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a session of one machine (as in tests)
    gets a local one; on a cluster that would be one machine's disk, so it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="tidewell-")
    return os.path.join(top, f"tidewell-{name}-{os.urandom(8).hex()}")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back: for what several steps read and executors may lose. ``scratch`` drops it."""
    path = shared_folder(rows.sparkSession, name)
    _WRITTEN.append(path)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what ``stored`` wrote inside: for use around an action that makes its result final."""
    first = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[first:]:
            drop_folder(spark, path)
        del _WRITTEN[first:]


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
