"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but ASCII letters, digits and what lies beyond ASCII parts words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: As WORD, over text whose letters have not been lower-cased yet.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], T]) -> T:
    """What ``make`` gave this worker under ``key``, for as long as its tasks ask for no other."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; before and after it a worker gives back memory that is free but still held.

    Workers serve one stage after the other. What Arrow and the C library keep
    of the batches of earlier stages would add up beside the executor's heap,
    and so would what ``held`` keeps; unless the stage ``holds`` something
    itself, a worker lets go of that first.
    """

    def give_back() -> None:
        if not holds:
            _held.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers that don't have it on their path; once a Spark application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="spark-")  # Spark serves the archive from here
        shutil.copytree(package, f"{folder}/in/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/in"))
        _shipped.add(context.applicationId)
