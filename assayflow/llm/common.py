"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; it goes when the
    driver's JVM ends.

    Where that setting is unset on a single machine (local master, as in tests), a temporary folder
    is made once and removed when the driver ends; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="assayflow-"))
            atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
        base = f"file://{_OWN_DIR[0]}"
    path = f"{base.rstrip('/')}/assayflow-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run through Spark's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Lets Spark drop the shuffle files of a query when it ends.
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lost executors cost
    no recomputation of what came before. Its shuffle files go at once."""
    conf = df.sparkSession.conf
    before = conf.get(_DROP, "false")
    conf.set(_DROP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(_DROP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster may instead
    install it or get it with --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names; extra columns, whatever they
    are called, cannot clash with what the operator adds."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def rows_of(batch: pa.RecordBatch, step: int = 512) -> Iterator[list[list]]:
    """Lists of a batch's columns, a bounded number of rows at a time."""
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield [part.column(i).to_pylist() for i in range(part.num_columns)]


def arrow_rows(
    df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: pa.Schema, ddl: str, step: int = 512
) -> DataFrame:
    """df.mapInArrow with fn(*column_lists) giving an iterable of result rows as tuples."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows_of(batch, step):
                out = list(fn(*columns))
                cols = list(zip(*out, strict=True)) if out else [()] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema
                )

    return df.mapInArrow(run, ddl)
