"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD_OUT_FOLD = 5, 0

_left: ContextVar[list[str] | None] = ContextVar("keyloom_scratch", default=None)
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from; those without an id are too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(True))


def identity(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text; null is the empty text."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body), F.xxhash64(F.lit(7), body)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. Only a plain local session, which has
    one machine, may go without ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        folder = _local[app]
    return folder


def materialize(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a
    lost executor costs no more than the files of the tasks it was running. The table goes
    with the ``scratch`` around the call, if there is one."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"keyloom-{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    if (held := _left.get()) is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path"] = path
    return out


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete materialized tables. Only when no DataFrame that reads them is still to be
    evaluated."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of all tables that the body materializes (those of this thread alone) and
    does not release itself."""
    paths: list[str] = []
    token = _left.set(paths)
    try:
        yield paths
    finally:
        _left.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that the body materializes are deleted at its end, but for those that it puts
    into the list it gets; these belong to the scope around it."""
    keep: list[DataFrame] = []
    with collected() as paths:
        yield keep
    kept = [df.__dict__["scratch_path"] for df in keep]
    release(spark, [p for p in paths if p not in kept])
    if (outer := _left.get()) is not None:
        outer.extend(kept)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that start with those wanted and clash with none of ``df``'s
    (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
