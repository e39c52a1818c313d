"""Session helpers: building a local session for tests/bench and resolving the
shared checkpoint folder a cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CACHED_ROWS_CONF = "spark.sql.inMemoryColumnarStorage.batchSize"
# bytes of one batch of rows that are kept on disk
BATCH_BYTES = 256 << 10
_keeping = threading.Lock()


def build_session(app: str = "recsmith", cpus: int | str = "*", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster the session is
    created by the launcher and only ``checkpoint_dir`` below is used."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RECSMITH_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``checkpoint()`` / intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. Only a local session may
    leave it unset (tests): a folder under its warehouse dir is used then. On a
    cluster a missing setting is an error, since executors would not share it.
    """
    sc = spark.sparkContext
    d = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        wh = spark.conf.get("spark.sql.warehouse.dir")
        d = wh.rstrip("/") + "/_recsmith_checkpoints"
        spark.conf.set(CHECKPOINT_CONF, d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: read again by other jobs without
    a cache that outlives them."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` computed once and kept, with its partitioning and order, on the
    executors' disks until ``unpersist``. Java's serializer holds on to the last
    100 batches that it wrote or read, so a batch has about BATCH_BYTES: with
    batches of Spark's default size two tasks hold 0.8 GB."""
    conf = df.sparkSession.conf
    with _keeping:
        usual = conf.get(CACHED_ROWS_CONF)
        conf.set(CACHED_ROWS_CONF, str(max(1, min(int(usual), BATCH_BYTES // max(1, row_bytes)))))
        try:
            df = df.persist(StorageLevel.DISK_ONLY)
            df.count()
        except BaseException:
            df.unpersist()
            raise
        finally:
            conf.set(CACHED_ROWS_CONF, usual)
    return df


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are gone: it does when the
    driver's JVM collects garbage, which may be never in a job of many plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_once(spark: SparkSession, *steps: Callable) -> list:
    """The results of steps that do not need each other, each a sequence of Spark
    jobs: while one waits on the driver or for its last task, others use the cores."""
    with ThreadPoolExecutor(len(steps)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]
        return [w.result() for w in waiting]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per session: a
    zip of its sources, served by Spark. Nothing is sent if the package's folder
    is on PYTHONPATH, which the launcher then gives to the workers."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(sc, "_recsmith_shipped", False) or root.parent in known:
        return
    out = Path(tempfile.mkdtemp(prefix="recsmith-ship-")) / "recsmith.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._recsmith_shipped = True
