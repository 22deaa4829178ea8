"""Reading the tables of a data folder, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in ``spark.checkpoint.dir``.

    Where the setting is missing (tests, a single machine) a temporary folder is set.
    """
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if here:
        return here
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: what follows reads the files, whichever executors are lost. The files
    go away with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    except Exception:  # a session without a JVM handle keeps the files
        pass
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    """The number of reduce tasks of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that take long for each row.

    Small inputs of one file come in one partition; inputs of many files pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``: a record delivered twice counts once.

    Of rows with one key and unlike values the smallest struct is kept, so the result doesn't
    depend on the order of the rows. ``max``/``min`` over structs combine before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
