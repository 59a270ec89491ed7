"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_session(app: str = "veilwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; callers may override any."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="veilwork-checkpoint-"))
        else:
            raise RuntimeError(
                "Set spark.checkpoint.dir to a folder every executor can reach; "
                "iterative operators write their intermediate tables there."
            )
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Iterative operators call this once per round, so that a lost executor costs
    one round and the plan does not grow with the rounds.  A Parquet table, unlike
    a checkpointed RDD, lets later steps read single columns and tells the
    optimizer its size.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work at least as many partitions as there are task slots.

    A table of few files would otherwise keep most slots idle.  A large table has
    more partitions than that already and is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
