"""Tables that a plan writes for itself: lineage ends there, and they survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one in the warehouse, or a temporary
    one if the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = "file://" + tempfile.mkdtemp(prefix="factorloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_factorloom"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of a Parquet row group: what a task that writes holds in memory.
BLOCK = 32 << 20
#: Paths that this process has written and not dropped.
STORED: list[str] = []


class Own(threading.local):
    """Paths that this thread has written, in order, dropped ones included."""

    def __init__(self):
        self.paths: list[str] = []


OWN = Own()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, and that drop_stored deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    STORED.append(path)
    OWN.paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", BLOCK).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete stored tables of this process, all or those of `paths`, once the results that read them are written."""
    for at in list(STORED) if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        STORED.remove(at)
