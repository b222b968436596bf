"""What the operators of this subpackage share: the staging folder and column handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls from tab to carriage return.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Folder of this driver's intermediate tables, under the shared one.
_RUN = uuid.uuid4().hex
_made: set[str] = set()
#: Whose tables this Python worker keeps, and what empties them.
_keeps: list[tuple[str, Callable[[], None]]] = []


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library (where it can) keep of freed memory for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def keep_tables(owner: str, empty: Callable[[], None]) -> None:
    """Say as a task begins whose tables the worker fills. A worker serves one stage after another and lives on between
    them; the tables of the operator before go, so that it holds those of one at most. What other tasks have freed goes
    back to the system."""
    if _keeps and _keeps[0][0] != owner:
        _keeps[0][1]()
    give_back()
    _keeps[:] = [(owner, empty)]


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path as it wants it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors share, under spark.checkpoint.dir; it goes when the driver ends. Where that is unset,
    a local one in local mode (as in tests), and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tailwise.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tailwise-")
        spark.conf.set("spark.tailwise.scratch", found)
    folder = f"{found.rstrip('/')}/tailwise/{_RUN}"
    if folder not in _made:
        fs, at = _file_system(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _made.add(folder)
    return folder


def staged(df: DataFrame, name: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what staged has written for these frames, once nothing will read it again. Shuffle files of finished
    queries stay until the driver's JVM collects its garbage, so it is asked to."""
    for df in frames:
        fs, at = _file_system(df.sparkSession, df._staged_at)
        fs.delete(at, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under its own names; null texts become empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(taken: list[str], wish: str) -> str:
    """wish, or wish with underscores in front until no column of that name exists (names compare without case)."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish = "_" + wish
    return wish
