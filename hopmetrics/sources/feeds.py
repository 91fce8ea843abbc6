"""Readers of the raw feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopmetrics.sources import schemas


#: Types of a file's column that are read as the declared one.
_READABLE = {"string": ("string", "binary"), "timestamp_ntz": ("timestamp_ntz", "timestamp")}


def read_transfers(spark: SparkSession, source: str, kind: str | None = None) -> DataFrame:
    """Transfer feed from a Parquet path or a catalog table.

    ``kind`` says which, ``path`` or ``table``; without it a source with "/" is a path.
    """
    return _read(spark, source, schemas.TRANSFER_FEED, kind)


def read_messages(spark: SparkSession, source: str, kind: str | None = None) -> DataFrame:
    """Contract-call message feed from a Parquet path or a catalog table; ``kind`` as above."""
    return _read(spark, source, schemas.MESSAGE_FEED, kind)


def _read(spark: SparkSession, source: str, schema: str, kind: str | None) -> DataFrame:
    if kind not in (None, "path", "table"):
        raise ValueError(f"kind must be path or table, not {kind!r}")
    fields = T.StructType.fromDDL(schema).fields
    if kind == "path" or kind is None and "/" in source:
        # A declared column that a file lacks would be read as NULLs without an error, and one
        # of another type would fail late, in a task.
        found = spark.read.parquet(source).schema
        _check_names(source, found.names, fields)
        _check_types(source, found, fields)
        return spark.read.schema(schema).parquet(source)
    rows = spark.table(source)
    _check_names(source, rows.columns, fields)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def _check_types(source: str, found: T.StructType, fields: list[T.StructField]) -> None:
    """One footer tells the types; a partition written with others still fails in its task."""
    types = {f.name.lower(): f.dataType.simpleString() for f in found.fields}
    wrong = {
        f.name: types[f.name]
        for f in fields
        if types[f.name] not in _READABLE.get(f.dataType.simpleString(), (f.dataType.simpleString(),))
    }
    if wrong:
        declared = {f.name: f.dataType.simpleString() for f in fields if f.name in wrong}
        raise ValueError(f"{source} has columns of other types: {wrong} instead of {declared}")


def _check_names(source: str, columns: list[str], fields: list[T.StructField]) -> None:
    missing = {f.name for f in fields} - {c.lower() for c in columns}
    if missing:
        raise ValueError(f"{source} lacks the columns {sorted(missing)}")
