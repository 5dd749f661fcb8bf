"""Materialise an intermediate result in the folder all executors share.

Used where a result is read more than once and recomputing it would repeat an
expensive pass, or where the rows carry an identity that must not change between
two reads. The folder is the session's ``spark.checkpoint.dir``; only where that
is unset (tests on one machine) a temporary one is made.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        # one machine and one process; anything else has executors elsewhere
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemill-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tidemill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table_cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back.

    Against ``checkpoint()`` this compresses, and later reads take only the
    columns they need. The table lives until ``release`` or the session's end.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this application cut; results read from them must have been consumed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            pass
