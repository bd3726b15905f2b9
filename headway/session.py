"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every job relies on; a cluster keeps whatever it has set itself.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "headway", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; `extra` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can see, as named by the cluster.

    Only a local session may fall back to its own warehouse folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df`; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders of this process's tables that nobody has removed yet.
_TABLES: dict[str, SparkSession] = {}


def settle(df: DataFrame, *cols: Column) -> DataFrame:
    """`df` with `cols`, worked out once per row.

    Spark writes the text of a computed column out anew wherever a later filter or
    projection reads it; it does not do so for the output of a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by `keys` over all shuffle partitions, at least eight a core, which Spark does not merge again.

    Merged ones are measured by their compressed bytes; rows that compress well fill a task's memory long before.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def save_table(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several jobs read into the shared folder and read it back.

    The table lives until `drop_tables` or the end of the process.
    """
    path = scratch_path(df.sparkSession, label)
    if not _TABLES:
        atexit.register(drop_tables)
    _TABLES[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are saved now, not at some later collection of the driver."""
    gc.collect()
    spark._jvm.System.gc()


def drop_tables() -> None:
    """Remove the tables that `save_table` has written in this process; results that read them are lost."""
    for path, spark in list(_TABLES.items()):
        del _TABLES[path]
        if spark.sparkContext._jsc is not None:       # stopped sessions cannot reach the folder any more
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
