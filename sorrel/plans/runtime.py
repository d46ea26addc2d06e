"""Session helpers: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[2])


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this library where only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names in spark.checkpoint.dir; name one only where none is set (tests, local mode)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sorrel-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from the written files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def width(spark: SparkSession) -> int:
    """Tasks of a CPU-heavy Python stage: two a core, or the session's shuffle partitions if those are more."""
    # Spark's own default counts where the session sets none; a fallback value given here would be validated and refused
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input of few files over all cores before a CPU-heavy Python stage.

    An input of as many files as cores, or of many splits, is split well enough by its scan and is not shuffled. Few files of few
    splits are shuffled: a file of one row group is one task, whatever its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < cores or df.rdd.getNumPartitions() > 2 * cores:
        return df
    return df.repartition(2 * cores)
