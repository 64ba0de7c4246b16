"""Working folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only on local masters."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(sc.applicationId) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="flowsieve-")
    return _LOCAL_DIRS[sc.applicationId]


def use_checkpoints(spark: SparkSession) -> None:
    """Have RDD checkpoints written to the working folder, unless the session names another one."""
    folder = work_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below one folder per application, which can be dropped when it has ended."""
    app = spark.sparkContext.applicationId
    return f"{work_dir(spark)}/flowsieve/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table and read it back.

    Used where a result is read several times or a loop must cut its lineage: the
    table survives lost executors, pins generated ids, and gives the planner its size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Drop the files of a table that ``stage`` wrote, once nothing will read it again."""
    spark = staged.sparkSession
    base = f"{work_dir(spark)}/flowsieve/"
    folders = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    for folder in folders:
        if "/flowsieve/" not in folder or folder.split("/flowsieve/")[0].split(":")[-1].lstrip("/") != base.split(
                "/flowsieve/")[0].split(":")[-1].lstrip("/"):
            raise ValueError(f"{folder} is not a working table")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
