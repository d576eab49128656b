"""Session helpers: worker import path, checkpoint folder, shared settings."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(app: str = "loomset", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


#: Bytes of one Arrow batch, where the session doesn't say: a worker's arrays are some tens of times as large.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


#: Let Python workers, which live on between tasks, give large freed arrays back to the system; without thresholds of its own
#: the allocator raises them to the largest array it has seen.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver imports it, and keep their batches small.

    On a cluster the package is deployed to the executors; the extra path entry is then harmless.
    """
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    env = spark.sparkContext.environment
    for name, value in WORKER.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[x for x in have if x]])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local master without that setting gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="loomset-checkpoint-")
        _OWN[sc.applicationId] = folder
    return folder


_OWN: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, wherever the shared folder is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
