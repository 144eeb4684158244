"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex and code points of the only characters that part words.
BLANK_PATTERN = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside 0x20 and 0x09-0x0D; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_PATTERN), "")


def free(df: DataFrame, name: str) -> str:
    """``name``, longer where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all
    tasks run on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/feedloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage: written as Parquet to the shared folder and read back, so a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing needs any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow; a worker lives on after its task, so what the task no longer uses goes back to the system."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: large arrays go back when freed
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
