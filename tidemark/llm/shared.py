"""Where shared intermediate results go, and how they leave."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_run: ContextVar[str | None] = ContextVar("run", default=None)  # the folder of the run that is going on in this thread


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, may leave it
    unset and gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: lineage and repeated work end here."""
    path = f"{_run.get() or shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables, once all that reads them is itself written."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            _delete(table.sparkSession, folder)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables that this thread writes inside, deleted at the end; what reads them must be written by then."""
    path = f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    before = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(before)
        _delete(spark, path)


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """A column name that no taken one equals, case aside."""
    low = {t.lower() for t in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, total: int, parts: int = 1000) -> DataFrame:
    """``rows`` joined with ``classes`` (a row a key, with its number of rows as ``count``), of which a few may hold most rows.

    Keys of more than a ``parts``-th of ``total`` rows are fewer than ``parts``: they are
    broadcast, so that their rows stay where they are. The other keys are shuffled.
    """
    often = F.col("count") * parts > total
    hot = F.broadcast(classes.where(often))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(classes.where(~often), key))
