"""Session helpers: building a session and finding its shared working folder."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "threadloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators expect; values in ``conf`` win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app).master(f"local[{cores or os.cpu_count()}]")
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset on a single machine (tests) a folder of this machine
    takes its place; on a cluster, whose machines could not read it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut there,
    and losing an executor afterwards costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task takes of what is dealt out by a key, and parts of a key's values for each task.
ROWS, PARTS = 250_000, 16


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks to deal ``rows`` rows out to: the more rows, the more tasks, so that none grows."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS))


def dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Deals ``df`` out to ``tasks`` tasks by ``part``, which it adds, a hash of ``key``: what is grouped by part and
    more is put together in the task itself, without another shuffle."""
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS * tasks)).cast("int")).repartition(tasks, "part")
