"""What the operators of this subpackage share: tables, column picking, the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch of texts. Texts may be long, and a batch is in memory several times over.
TEXT_ROWS = 1_024

_resident: dict[tuple, Any] = {}


def give_back() -> None:
    """Gives memory that Python no longer needs back to the system."""
    gc.collect()
    with contextlib.suppress(ImportError, OSError, AttributeError):
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps between tasks. It keeps that of one operator at a time: what a worker that Spark
    uses again still held for an earlier one is given back to the system first."""
    if key not in _resident:
        if _resident:
            _resident.clear()
            give_back()
        _resident[key] = make()
    return _resident[key]


def text_batches(df: DataFrame) -> DataFrame:
    """Has Spark send texts to Python in batches of TEXT_ROWS."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by their exact names.

    Other columns, whatever they are called (also names that differ in case or repeat), are left
    out, so they can't clash with what an operator adds. The first of repeated names counts.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*places).select(*[F.col(places[df.columns.index(n)]).alias(n) for n in names])


class Carried:
    """A table's columns packed into one, `row_`, so that nothing an operator adds can clash with them."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        places = [f"c{i}" for i in range(len(self.names))]
        self.rows = df.toDF(*places).select(F.struct(*places).alias("row_"))

    def __getitem__(self, name: str) -> Column:
        return F.col(f"row_.c{self.names.index(name)}")

    def place(self, name: str) -> int:
        return self.names.index(name)

    def restored(self, df: DataFrame) -> DataFrame:
        return df.select("row_.*").toDF(*self.names)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where there is none and all tasks run in this process, as in tests, a
    temporary one is set; on a cluster that would be a folder of one machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    set_before = context._jsc.sc().getCheckpointDir()
    if not set_before.isDefined():
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parallaxis-"))
        set_before = context._jsc.sc().getCheckpointDir()
    return str(set_before.get()).rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a DataFrame as Parquet into the shared folder and reads it back: its lineage is cut and an
    executor that goes takes nothing with it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made; for those that nothing reads any more, also not a result that isn't computed yet."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
