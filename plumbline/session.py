"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNED: ContextVar[list[str] | None] = ContextVar("owned_folders", default=None)


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Owns every folder written by ``new_folder`` and ``materialize`` inside; deletes them at the end.

    Also after a failure. Results are lazy and may read these folders, so write or collect them
    inside the scope. An inner scope owns what is written inside it. Without a scope folders stay for
    the cluster's own clean-up. Scopes of different threads do not meet.
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in owned:
            delete_folder(spark, path)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nobody else has; the current run scope owns it."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


def folder_system(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it names it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system; one that is not there is no error."""
    system, at = folder_system(spark, path)
    system.delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Later passes read only the columns they need and never repeat the shuffles
    before the cut; a lost executor re-reads files instead of recomputing.
    """
    path = new_folder(df.sparkSession, "table")
    names = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*names).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)
