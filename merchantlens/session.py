"""Session defaults and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("merchantlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Recording the call site of every column costs more than the column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    What jobs write below it stays until the folder is cleaned: results are lazy
    and may still read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never used twice."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether the files of a query's shuffles go as the query ends (Spark 4.1 and later).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, not a recompute.  A written table is
    preferred over ``checkpoint()`` because it evaluates the plan once, where an
    eager checkpoint counts the rows first and computes them again to save them.
    Shuffle files go as the table is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.select("*").write.parquet(path)  # a frame has the setting it was made under
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote, once nothing reads it any more.

    Only folders of its own below the shared folder are removed; the folder is reached
    through Spark, so it may lie in any store.
    """
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/cut-"
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("cut-") and own.split(":", 1)[-1] in folder:
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Set to "true" for merchants too many to be broadcast (``kpis.join_merchants``).
MANY_MERCHANTS = "merchantlens.manyMerchants"


def many_merchants(spark: SparkSession) -> bool:
    """Whether the session says that its merchants are too many to be broadcast."""
    return spark.conf.get(MANY_MERCHANTS, "false") == "true"
