"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
#: Tables that :func:`written` made and :func:`release` has not removed.
_TABLES: list[str] = []


def local_session(cores: str | int = "*", app: str = "threadloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_SETTINGS, **conf}.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, which a cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a folder of its own, removed at exit; any other is refused, since no
    machine's own folder is one that all executors share.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="threadloom-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, written once to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    For loops: a checkpoint keeps the size estimate of the plan that it replaces, and over many rounds of joins the estimates
    multiply without end; a table's estimate is its size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables that :func:`written` made (those after the first ``since``).  Results not yet computed may still need them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _TABLES[since:]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _TABLES[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are removed at its end."""
    since = len(_TABLES)
    try:
        yield
    finally:
        release(spark, since)


def tasks(spark: SparkSession) -> int:
    """Number of partitions that a wide operator should use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
