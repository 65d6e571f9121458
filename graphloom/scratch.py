"""Tables written between jobs, in the folder that the cluster shares.

`spark.checkpoint.dir` names that folder. Only where it is unset (tests, a
single machine) a temporary folder is made; on a cluster that is an error. A written table cuts the lineage:
a lost executor costs the tasks in flight, not the stages before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _own_root
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="spark-graphloom-")
    return _own_root


#: Whether Spark deletes the shuffle files of a query when it has ended; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return the written table; the shuffle files of writing it go."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")  # keys are hex digits, which lighter codecs leave as they are
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `materialize` that no lazy plan still reads."""
    for df in tables:
        path = getattr(df, "_graphloom_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
