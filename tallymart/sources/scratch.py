"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes an execution's shuffle files at its end, instead of when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where the session names none, a local master (tests) gets a
    folder of its own; a cluster, whose machines would each write to their own disk, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/tallymart-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, so that a lost executor costs one stage at most. The shuffle
    files that made it go with that, since nothing reads them any more."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tallymart-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
