"""Tables in the shared folder that end a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process wrote and has not dropped.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where a session in one process (``local``) names none, a temporary one for as long as that process
    lives; on a cluster that is an error, since executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def noted(path: str) -> str:
    """``path``, which ``drop_cuts`` then deletes as well."""
    _written.append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written there and read back, so that neither iterations nor a lost executor replay what
    came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(noted(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Deletes the tables that this process has cut so far, once no result still reads them; returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += path.getFileSystem(conf).delete(path, True)
    return done
