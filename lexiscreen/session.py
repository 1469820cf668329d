"""Session settings the jobs are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Runtime settings that change plans, not results.  AQE splits skewed join
#: partitions and turns shuffled joins into broadcasts from measured sizes;
#: the broadcast threshold is the size check for every dimension table.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine.  Cluster jobs bring
    their own session; only SETTINGS matter there."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexiscreen")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("lexiscreen.scan.tasks", cpus)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; only
    where none is named and all runs in one process, as in tests, a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lexiscreen-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
