"""Where lineage is cut: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Only a local session, as in tests, has one made for it; a cluster must name one that all its machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables that :func:`stored` has written in this session and nobody has removed.
_WRITTEN: list[str] = []


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    place, store = _path(spark, path)
    return store.exists(place)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that :func:`stored` writes inside the block. For jobs that have written their result before it ends: nothing that is read later may depend on such a table."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            place, store = _path(spark, path)
            store.delete(place, True)
        del _WRITTEN[before:]


def stored(df: DataFrame) -> DataFrame:
    """The same through a Parquet table: smaller than a checkpoint, and readers take only the columns they use."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
