"""Written intermediate tables and size checks that operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where it is unset, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        sc.setCheckpointDir(path)
    return path


#: Where the shared folder is a mounted one, scratch tables have no checksum files beside them: half the files, and without
#: native Hadoop libraries half the processes that set their permissions. Other stores do not read these options.
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stash(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder, so that what follows does not run it again
    and a lost executor costs only a read. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    df.write.options(**SCRATCH).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df
