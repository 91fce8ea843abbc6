"""The bridge relation as a date-partitioned Parquet table.

Decoding JSON is by far the most expensive step, and every report needs the same
small set of columns. Writing the relation once replaces the two feed scans of
each report by a column-pruned, partition-pruned scan of a narrow table.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.functions.calendar import PARTITION_COLUMNS, as_date, date_range, day_start
from hopmetrics.sources import schemas

# Rows of the table are narrow, and an aggregation keeps several entries for each
# in memory. Row groups of this size let a scan be split finely enough (with
# spark.sql.files.maxPartitionBytes to match) for those entries to fit.
ROW_GROUP_BYTES = 32 * 1024 * 1024

#: File in a table that names the refresh under way.
MARKER = "_refresh"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting falls back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="hopmetrics-")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partition_start(partition: str, day: dt.date | str) -> dt.date:
    """First day of the partition that holds ``day``."""
    day = as_date(day)
    return day.replace(day=1) if PARTITION_COLUMNS[partition] == "month" else day


def write_bridges(
    bridges: DataFrame, path: str, partition: str = "created_day", mode: str = "errorifexists"
) -> None:
    """Write one folder per calendar day (or month, for a smaller history).

    The rebalance hint lets adaptive execution split a hot day over several
    tasks and files, and merge the tiny ones, at the advisory partition size.
    Rows are sorted by time within a file so that row groups can be skipped.
    ``mode="overwrite"`` replaces only the partitions present in ``bridges``;
    ``refresh_bridges`` replaces all from a day on.
    """
    grain = PARTITION_COLUMNS[partition]
    (
        bridges.withColumn(partition, day_start(grain, F.to_date("created_at")))
        .hint("rebalance", partition)
        .sortWithinPartitions(partition, "created_at")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy(partition)
        .parquet(path)
    )


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _partitions(spark: SparkSession, path: str, partition: str) -> list[str]:
    """Folders of the table; raises if one is not of that partition column."""
    folder, files = _file_system(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    names = [name for name in names if not name.startswith(("_", "."))]
    for name in names:
        if not name.startswith(f"{partition}="):
            raise ValueError(f"{path} is not partitioned by {partition}: it holds {name}")
    return names


def _read_marker(spark: SparkSession, path: str) -> dict | None:
    """The refresh under way in this table: its first day, partition column and folder of new rows."""
    marker, files = _file_system(spark, f"{path}/{MARKER}")
    if not files.exists(marker):
        return None
    stream = files.open(marker)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_marker(spark: SparkSession, path: str, content: dict) -> None:
    """In one step: written under another name, then renamed."""
    marker, files = _file_system(spark, f"{path}/{MARKER}")
    made, _ = _file_system(spark, f"{path}/{MARKER}-{uuid.uuid4().hex}")
    stream = files.create(made, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if not files.rename(made, marker):
        raise OSError(f"could not write {path}/{MARKER}")


def _new_rows_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders beside the table that refreshes wrote their rows to."""
    table, files = _file_system(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(table.getParent())]
    return [f"{path.rstrip('/')}{name[len(table.getName()):]}" for name in names if name.startswith(f"{table.getName()}.refresh-")]


def _on_or_after(name: str, first: dt.date) -> bool:
    value = name.split("=", 1)[1]
    return value != "__HIVE_DEFAULT_PARTITION__" and dt.date.fromisoformat(value) >= first


def refresh_bridges(
    bridges: DataFrame,
    path: str,
    since: dt.date | str,
    partition: str = "created_day",
    schema: str = schemas.BRIDGES,
) -> None:
    """Replace all partitions from that of ``since`` on by the rows of ``bridges`` from there on.

    Partitions in which ``bridges`` has no row are removed, rows without a time stay. The
    new rows are first written beside the table. A marker in the table then names them and
    their range: from that moment on readers take the range from there, before it from
    the table, so that they see either the old rows or the new ones. After that the new
    rows are copied into the table, what is left of the old ones is removed, and the
    marker goes last. A driver may die anywhere: without a marker nothing has happened,
    with one the next refresh completes the copy first. One refresh of a table runs at a time.
    """
    spark = bridges.sparkSession
    finish_refresh(spark, path, schema)
    first = partition_start(partition, since)
    _partitions(spark, path, partition)
    for folder in _new_rows_folders(spark, path):  # of earlier refreshes, for readers that had begun
        _delete(spark, folder)
    beside = f"{path.rstrip('/')}.refresh-{uuid.uuid4().hex}"
    write_bridges(date_range(bridges, first), beside, partition)
    _write_marker(spark, path, {"first": first.isoformat(), "partition": partition, "folder": beside})
    finish_refresh(spark, path, schema)


def finish_refresh(spark: SparkSession, path: str, schema: str = schemas.BRIDGES) -> None:
    """Complete the refresh that a marker names; nothing to do without one. May be run again."""
    marker = _read_marker(spark, path)
    if marker is None:
        return
    partition, first = marker["partition"], dt.date.fromisoformat(marker["first"])
    rows = _read(spark, marker["folder"], partition, schema).drop(partition)
    write_bridges(rows, path, partition, "overwrite")
    made = set(_partitions(spark, marker["folder"], partition))
    for name in _partitions(spark, path, partition):
        if name not in made and _on_or_after(name, first):
            _delete(spark, f"{path}/{name}")
    _delete(spark, f"{path}/{MARKER}")


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = _file_system(spark, path)
    files.delete(folder, True)


def _read(spark: SparkSession, path: str, partition: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {partition} DATE").parquet(path)


def read_bridges(
    spark: SparkSession, path: str, partition: str = "created_day", schema: str = schemas.BRIDGES
) -> DataFrame:
    """The written relation with its partition column, which ``date_range`` prunes by.

    Raises if the table is partitioned by another column. Where a refresh has not been
    completed, the rows of its range come from beside the table.
    """
    table = _read(spark, path, partition, schema)
    _partitions(spark, path, partition)
    marker = _read_marker(spark, path)
    if marker is None:
        return table
    before = F.col(partition).isNull() | (F.col(partition) < F.lit(marker["first"]).cast("date"))
    return table.filter(before).unionByName(_read(spark, marker["folder"], partition, schema))


def write_report(report: DataFrame, path: str) -> None:
    """Result sink: one report as Parquet."""
    report.write.mode("errorifexists").parquet(path)
