"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.errors import InvalidDataError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder, gone with the process, only where none is set and one machine does it all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidDataError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidelog-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidelog/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that lives until drop_scratch()."""
    return f"{_scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's tables made under scratch(); frames that read them are of no more use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a range partition, as planned; tables that joins make count as GROWN times what they read at most.
PARTITION, GROWN, UNKNOWN = 128 << 20, 4, 1 << 60


def partitions(df: DataFrame) -> int:
    """Range partitions that suit a table's size, by its plan's estimate; at least as many as the session shuffles into.

    Leaves of unknown size (rows that the driver made) count for nothing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = min(int(str(plan.stats().sizeInBytes())), GROWN * sum(n for n in sizes if n < UNKNOWN))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))


def cut(df: DataFrame) -> DataFrame:
    """`df` from a checkpoint in the shared folder: the same partitions, whatever is lost."""
    sc, found = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return df.checkpoint(eager=True)
