"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none (a local test session) gets one of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="prefweave-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage.

    The files survive the loss of executors, and a frame that is read more than once is
    computed once.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoints(spark: SparkSession) -> set[str]:
    """Paths of this application's checkpoints."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        return set()
    path = sc._jvm.org.apache.hadoop.fs.Path(folder.get())
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    return {s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("rdd-")} if fs.exists(path) else set()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made within are deleted at the end; write or collect results before it.

    Frames made within can't be read afterwards. Not for several queries of one application at once: it takes
    whatever was checkpointed meanwhile for its own.
    """
    checkpoint_dir(spark)
    before = _checkpoints(spark)
    try:
        yield
    finally:
        sc = spark.sparkContext
        for p in sorted(_checkpoints(spark) - before):
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on one machine, for tests and the benchmark."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("prefweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
