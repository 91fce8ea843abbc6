"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Documents are put in order of ``doc_id`` by a range partitioning whose partitions
("blocks") are written down. The blocks' totals, a row per block, give each block its
offset; a running sum inside the block then gives each row its place in the whole, and
the whole is cut at equal byte targets. Built-in functions only.

Cases: a null text has no bytes and the checksum of an empty text. Null ids come first;
equal ids stand by checksum, size and then as they were read, so a third of all rows
under one id is still spread over many blocks. With fewer rows than shards some shards
stay empty. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopmetrics.llm import common

N_SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def ordered_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, arrival and block, written to the shared folder."""
    text = common.text_or_empty()
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("arrival"),
    )
    ranged = sized.repartitionByRange("doc_id", "text_crc32", "size", "arrival")
    # A block's number has to stay the same for all that follows: hence the written table.
    return common.durable(ranged.withColumn("block", F.spark_partition_id()))


def byte_shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, before (bytes ahead of the row), shard and slot.

    A row goes to the shard whose byte range holds the row's middle, so a shard's size
    differs from an n-th of the whole by less than a row at either end.
    """
    blocks = ordered_blocks(docs)
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row per block: as many as range partitions, however many documents there are.
    totals = blocks.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("block").orderBy("doc_id", "text_crc32", "size", "arrival")
    placed = (
        blocks.withColumns(
            {
                "sum_in": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                "row_in": F.row_number().over(inside),
            }
        )
        .join(F.broadcast(offsets), "block")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("bytes_ahead") + F.col("sum_in") - F.col("size")).alias("before"),
            (F.col("rows_ahead") + F.col("row_in") - 1).alias("place"),
            "total",
        )
        .withColumn("shard", F.expr(f"cast((2 * before + size) * {n_shards} div (2 * total) as int)"))
    )
    # At most n_shards rows.
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "before", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = byte_shards(common.table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The checksum by its definition: eight shifts per byte value, folded over the bytes.
ORACLE = f"""
WITH RECURSIVE steps AS (
    SELECT b AS byte, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8
), bytes AS (
    SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                          lambda x: ('0x' || x)::BIGINT) AS b
    FROM documents
), summed AS (
    SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total,
           xor(4294967295, list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]),
                                       4294967295::BIGINT)) AS text_crc32
    FROM bytes, crc
), cut AS (
    SELECT *, ((2 * before + size) * {N_SHARDS} // (2 * total))::INTEGER AS shard FROM summed
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
