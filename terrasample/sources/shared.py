"""Intermediate tables in the folder that the driver and all executors share, and this package on the executors.

A table that is written and read back ends its lineage: rows keep their values
whatever is recomputed, and a lost executor costs no earlier stage.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once per application (they needn't see the driver's folders)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="terrasample-")) / "terrasample_pkg.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(name))


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Shared folders made within (by this thread) lie below one that is deleted at the end, with all their tables."""
    folder = shared_folder(spark)
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        discard(spark, folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (or, within :func:`scratch`, below its folder).

    Where that is unset, a temporary folder serves a local session; on a cluster
    others couldn't read it, so a RuntimeError says what to set.
    """
    base = _scratch.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrasample-ckpt-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/terrasample-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to ``folder/name`` and read it back; ``batch_rows`` bounds the Arrow batches of its Python steps."""
    path, spark = f"{folder}/{name}", df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, min(batch_rows, int(before)) if int(before) > 0 else batch_rows)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: A table of more rows isn't sent through the driver to all executors.
SENT_ROWS = 1 << 16


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a written table (``rows`` of another one), joined by sort and merge where it has more than SENT_ROWS rows.

    Spark takes it to be as large as its compressed files, so a join could broadcast a table of a hundred times that size.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > SENT_ROWS else df


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables below a shared folder (all of it without names) that nothing reads any more."""
    jvm = spark._jvm
    for name in names or ("",):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}".rstrip("/"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
