"""Tables in the folder that driver and executors share, for plans that run in several steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary one is set on a single machine, as in tests; on a cluster that is
    an error, as executors would not see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="veridra-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/veridra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def store(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read again: its lineage is cut, and a lost
    executor costs no recomputation. The table stays; see ``Scratch`` for those that don't."""
    return _stored(df)[0]


class Scratch:
    """Tables in the shared folder that are deleted at the end of the block; what the block returns
    has to be stored outside of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame) -> DataFrame:
        out, path = _stored(df)
        self.paths.append(path)
        return out

    def drop(self, most: int = 0) -> None:
        """Deletes all tables but the ``most`` latest."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while len(self.paths) > most:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
