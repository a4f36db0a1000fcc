"""Places that every executor can reach.

Intermediate tables go below ``spark.checkpoint.dir``; a folder of the local machine is used only
where that setting is missing and the session runs in one process, as in tests.
"""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import freed


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether what is read next leaves its list of files in the session's cache.
CACHES_LISTS = "spark.sql.hive.manageFilesourcePartitions"
#: Tables that are written between two looks for what may go.
BETWEEN = 6
_made = itertools.count(1)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _added(df, path)
    out = _listed_once(spark, df.schema, path)
    out.scratch_at = path
    if next(_made) % BETWEEN == 0:
        released(spark)
    return out


def written_in_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts, of which there is one at least, from one table; what a part leaves is deleted before the next."""
    for k, df in enumerate(parts):
        if not k:
            path = scratch_path(df.sparkSession, name)
        _added(df, path)
        released(df.sparkSession)
    out = _listed_once(df.sparkSession, df.schema, path)
    out.scratch_at = path
    return out


def _added(df: DataFrame, path: str) -> None:
    # What is read next is known to be whole, so that no file has to say so.
    df.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)


def _listed_once(spark: SparkSession, schema, path: str) -> DataFrame:
    """The table without a place in the session's cache of files, which keeps the lists of deleted tables too and takes
    up to 250 MB of the driver."""
    managed = spark.conf.get(CACHES_LISTS)
    spark.conf.set(CACHES_LISTS, "false")
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(CACHES_LISTS, managed)


def pointed(df: DataFrame) -> DataFrame:
    """The same for small tables that are used more than once or end a round of an iteration. A checkpoint()
    would hand on the constraints of its plan, which grow from round to round until planning takes longer than
    the work."""
    return written(df, "table")


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more. Shuffle files and broadcasts of finished steps
    go when the driver's garbage is collected, which it is asked for here, since a driver with little garbage waits
    long; the driver's own memory shrinks as well."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    freed()
    jvm.System.gc()


def shrunk(spark: SparkSession) -> None:
    """The same on executors, for steps whose Python workers need memory beside them: a heap that earlier steps have grown
    is not handed back by itself while its executor is busy, although hardly any of it is used between two steps. As many
    tasks as there are cores collect garbage, so that every executor that is there has one."""
    released(spark)
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
