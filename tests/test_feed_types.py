"""Feed readers judge names, types and kind of a source before anything runs."""

from __future__ import annotations

import pytest
from conftest import ts

from hopmetrics.sources import feeds, schemas

ROW = ("m", ts("2024-01-01"), "executed", "received", "{}")


def test_a_wrong_type_is_named(spark, tmp_path):
    path = f"{tmp_path}/messages"
    spark.createDataFrame([ROW], schemas.MESSAGE_FEED).selectExpr(
        "id", "'2024-01-01' AS created_at", "status", "1 AS simplified_status", "data"
    ).write.parquet(path)
    with pytest.raises(ValueError, match="'created_at': 'string', 'simplified_status': 'int'"):
        feeds.read_messages(spark, path)


def test_a_zoned_time_is_read(spark, tmp_path):
    path = f"{tmp_path}/messages"
    spark.createDataFrame([ROW], schemas.MESSAGE_FEED).write.parquet(path)
    assert feeds.read_messages(spark, path).schema["created_at"].dataType.simpleString() == "timestamp_ntz"
    assert feeds.read_messages(spark, path, "path").count() == 1


def test_the_kind_decides(spark, tmp_path):
    spark.createDataFrame([ROW], schemas.MESSAGE_FEED).createOrReplaceTempView("`a/b`")
    assert feeds.read_messages(spark, "`a/b`", "table").count() == 1
    with pytest.raises(ValueError, match="path or table"):
        feeds.read_messages(spark, "x", "file")
