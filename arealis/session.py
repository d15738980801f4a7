"""Session helpers: settings that suit the operators, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE splits hot join partitions and picks
# broadcast joins from measured sizes, so no operator hints a broadcast itself.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # partitions by their measured size, not by the number of cores
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "arealis", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``__`` for dots in keys."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Where that setting is missing, a session on one machine uses a temporary folder; on a
    cluster, whose executors couldn't see it, it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arealis-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by one job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def tasks_for(work: int | None, per_task: int) -> int:
    """Tasks for work that partition sizes don't show: AQE joins partitions by bytes, and a few small rows can stand for
    much work. A repartition by this number is left as it is."""
    return max(1, -(-int(work or 0) // per_task))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
