"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Stands for a null document id: such a document comes after all others.
NO_ID = 2**63 - 1

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_tables: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hopmetrics-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what lies before, and
    what comes after always sees the same rows in the same files. The tables of a
    session are removed when its driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_remove_all)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of ``durable`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        for spark, path in _tables:
            if path.split("/")[-1] in file:
                _remove(spark, path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_all() -> None:
    for spark, path in _tables:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    _tables.clear()


_kept: list[tuple[object, object]] = []


def kept_in_worker(key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for all tasks of a Python worker that ask for ``key``.

    A worker outlives its stage, so it keeps only the one asked for last: what an earlier
    stage learned makes room.
    """
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


def forget_kept() -> None:
    """Drop what this Python worker keeps, in tasks that need nothing of it."""
    _kept.clear()


def doc_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
