"""Session helpers: table access and intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
import warnings
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only where that is unset and everything runs on this machine one is made and set. On a
    cluster a folder of this machine would be another one on every executor, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
        path = tempfile.mkdtemp(prefix="fieldwatch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    """Remove a written table when the driver ends: by the file system here where it is mounted, else by the cluster's own."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        atexit.register(shutil.rmtree, url.path, ignore_errors=True)
    else:
        atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a path on any file system that the session knows; a session that has ended can't."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:
        warnings.warn(f"{path} could not be removed: {e}", stacklevel=1)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors and
    gives the optimizer real sizes. Every call has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _discard(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(rows: int, target_rows: int, least: int = 1) -> int:
    """Number of range partitions of about ``target_rows`` rows each."""
    return max(least, math.ceil(rows / target_rows))
