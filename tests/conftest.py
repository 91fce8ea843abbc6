from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hopmetrics.sources import schemas  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("hopmetrics-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def bridge_rows(spark):
    """Bridge rows from dicts; columns left out are NULL."""
    names = [part.split()[0] for part in schemas.BRIDGES.strip().split(",")]

    def make(rows):
        tuples = [tuple(row.get(name) for name in names) for row in rows]
        return spark.createDataFrame(tuples, schemas.BRIDGES)

    return make


@pytest.fixture(scope="session")
def transfer_feed(spark):
    """Transfer feed of one settled record per payload text, ids "0", "1", ..."""

    def make(payloads, **envelope):
        base = {
            "created_at": ts("2024-01-01"),
            "recipient_address": "w",
            "sender_address": "0xROUTER",
            "status": "executed",
            "simplified_status": "received",
            **envelope,
        }
        rows = [(str(i), *base.values(), data) for i, data in enumerate(payloads)]
        return spark.createDataFrame(rows, schemas.TRANSFER_FEED)

    return make


@pytest.fixture(scope="session")
def message_feed(spark):
    def make(payloads):
        rows = [(str(i), ts("2024-01-01"), "executed", "received", data) for i, data in enumerate(payloads)]
        return spark.createDataFrame(rows, schemas.MESSAGE_FEED)

    return make


def tuples(frame):
    return [tuple(row) for row in frame.collect()]


def by_key(frame):
    """First column -> the rest."""
    return {row[0]: tuple(row[1:]) if len(row) > 2 else row[1] for row in frame.collect()}
