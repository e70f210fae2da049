"""Cutting lineage so that a lost executor never loses an intermediate result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only in local mode, where one machine is all there is, a session that names none gets
    a folder of its own, which goes when the process ends. A cluster without one is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="granary-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder (columnar: later reads prune columns)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables this application has written so far, once no frame needs them any more; says how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
