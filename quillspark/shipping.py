"""Give executors this package, for sessions whose workers cannot import it otherwise, and work to all of them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Add the package's files to the application once; Spark copies them to each executor."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="quillspark-py-"), "quillspark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                full = os.path.join(folder, name)
                z.write(full, os.path.join("quillspark", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _done.add(sc.applicationId)


#: Bytes of a Parquet row group, as writers lay them out by default.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if its input may have fewer row groups than there are cores.

    Only whole row groups are read in parallel, so one small file keeps one core busy however it is split.
    An input below a row group for each core is dealt out by rows, a shuffle of at most that
    size; a larger one has groups enough, and is left where it is, as are streams.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP else df
