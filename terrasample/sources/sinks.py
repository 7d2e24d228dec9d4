"""Sinks: tables in Spark's own files, small metadata as JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.sources.shared import ship

VERSION = "0.1.0"


def write_table(df: DataFrame, folder: str, name: str, form: str, single: bool = False) -> str:
    """Write ``df`` in row order to ``folder/name.form``, a directory of part files, and return its path.

    Parts are written in parallel; their names keep the order.  ``single``: one
    part, for small results that other tools read.
    """
    path = f"{folder.rstrip('/')}/{name}.{form}"
    w = (df.coalesce(1) if single else df).write.mode("overwrite")
    if form == "csv":
        w.csv(path, header=True)
    elif form == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"Unknown format {form!r}")
    return path


def sidecar(
    batch_id: str, *, n_points: int, config: dict[str, Any], datasets: dict[str, Any],
    warnings: dict[str, Any] | None = None
) -> dict[str, Any]:
    """When and how a run was made, what was asked for and where the data came from."""
    out = {
        "run": {"timestamp": datetime.now().astimezone().isoformat(timespec="seconds"), "package_version": VERSION, "n_points": n_points},
        "config": {"batch_id": batch_id, **config}, "datasets": datasets
    }
    return out | ({"warnings": warnings} if warnings else {})


def _qualified(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Spark's file system of a path (relative local ones from the driver's folder) and the whole path."""
    whole = path if "://" in path or path.startswith("/") else os.path.abspath(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(whole)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, at.makeQualified(fs.getUri(), fs.getWorkingDirectory())


def write_sidecar(spark: SparkSession, content: dict[str, Any], folder: str, name: str) -> str:
    """Write metadata as JSON to any folder that Spark can write; its path."""
    path = f"{str(folder).rstrip('/')}/{name}_metadata.json"
    fs, at = _qualified(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(content, indent=2, default=str).encode()))
    finally:
        out.close()
    return path


#: Of a file name: the characters that stay as they are, and its greatest length.
_KEPT, MOST = "[^A-Za-z0-9._-]", 180


def file_name(c: Column) -> Column:
    """A text as a file name: what could leave a folder, hide a file or need quoting becomes _; such names, and long ones, end with a hash of the text.

    Equal texts have equal names and different ones different names (up to a 64-bit hash); null is "none".
    """
    text = F.coalesce(c.cast("string"), F.lit("none"))
    plain = F.regexp_replace(F.regexp_replace(text, _KEPT, "_"), "^[.]+", "_")
    changed = (plain != text) | (F.length(text) > MOST) | (text == "")
    return F.when(changed, F.concat(F.substring(plain, 1, MOST - 20), F.lit("-"), F.lower(F.hex(F.xxhash64(text))))).otherwise(plain)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, content and, where there is one, error) as a file of that name below ``folder``; name, written and error of each row, once asked for.

    Tasks write their own files, under another name first, so a repeated task
    leaves whole files.  A null content is not written, and a file that can't be
    written, or whose name would leave the folder, isn't either (written = false, with the
    error); all others are.  ``folder`` is local or in a store that Arrow's file systems know.
    """
    ship(rows.sparkSession)
    _, at = _qualified(rows.sparkSession, folder)
    uri = at.toString()
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as stores

        fs, base = stores.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)

        def put(name: str | None, content: pa.Scalar) -> None:
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"{name!r} is no file name")
            part = f"{base}/.{uuid.uuid4().hex}"
            try:
                with fs.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                fs.move(part, f"{base}/{name}")
            except (OSError, ValueError):
                if fs.get_file_info(part).type != stores.FileType.NotFound:
                    fs.delete_file(part)
                raise

        for batch in batches:
            names = batch.column("name").to_pylist()
            errors = batch.column("error").to_pylist()
            written = []
            for k, (name, content) in enumerate(zip(names, batch.column("content"), strict=True)):
                if content.is_valid:
                    try:
                        put(name, content)
                    except (OSError, ValueError) as e:
                        errors[k] = f"{type(e).__name__}: {e}"
                written.append(content.is_valid and errors[k] is None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(written), pa.array(errors, pa.string())], names=["name", "written", "error"])

    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.select("name", "content", error.alias("error")).mapInArrow(run, "name string, written boolean, error string")
