"""Session helpers.

The library never creates a global session: every operator takes and
returns DataFrames. These helpers exist for tests, ``bench.py`` and the
iterative jobs that need a reliable checkpoint location.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "basketry") -> SparkSession:
    """A local session with the settings the tests and the benchmark use.

    AQE stays on so that joins whose sides turn out small at run time are
    re-planned as broadcast joins and skewed partitions are split.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only on a local master, where the setting is absent (a laptop or a test
    run), is a private folder created and registered, so that
    ``DataFrame.checkpoint`` works; a cluster without the setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = sc.getConf().get("spark.checkpoint.dir", None)
    if not target and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = target or tempfile.mkdtemp(prefix="basketry-ckpt-")
    sc.setCheckpointDir(target)
    return target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root for written intermediate tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/basketry/{name}-{uuid.uuid4().hex[:12]}"
