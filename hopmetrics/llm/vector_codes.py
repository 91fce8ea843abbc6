"""Vector compression to four code bytes, exact in whole numbers.

Each component x becomes floor(1024 x). Vectors are cut into ``PARTS`` equal consecutive
parts; each part position has a codebook of up to ``ENTRIES`` entries, which starts as that
part of the rows with the smallest ids. A round gives every part its nearest entry
(squared Euclidean distance, the first of equally near ones) and replaces each entry by
the componentwise floor(sum / count) of its parts; an entry without parts stays.

Distances are |x|^2 - 2 x.y + |y|^2, with the products by limb-split float64 matrix
products (``exact.matmul``): exact in int64 as far as every distance fits there, which
the largest components tell beforehand. Blocks with larger ones are worked out in
Python's integers, so that the codes are exact for all integers below 2^52 in magnitude.

Each round is one pass over the vectors. A task holds one block of rows and the
codebooks, and gives back one row per codebook cell with its sum (in two halves, so that
their sums fit into longs) and count; the driver gets the cells' totals, as many as the
codebooks have components. Nothing that grows with the rows is held or broadcast.

Cases: rows whose vector is null, empty or holds a null or a non-finite component are
dropped. Equal ids are taken in the order of their vectors, null ids last. With fewer rows
than ``ENTRIES`` the codebooks have as many entries as there are rows. Repeated rows count
and are coded one by one. An error that does not fit into a long is null, and so is a
label's total with such an error in it; components of 2^52 / 1024 and more, vectors of
different lengths and lengths that the parts do not divide raise an error. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common, exact, vectors

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Groups that a label's rows are dealt to when its total is joined to them.
SALTS = 32


def kept(rows: DataFrame) -> DataFrame:
    """vec_id, label, v: the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v"))
    return sound.filter(vectors.finite(F.col("v")))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row, and the squared distance (object if it may leave int64)."""
    farthest = (exact.largest(x) + exact.largest(entries)) ** 2 * x.shape[1]
    if farthest <= exact.LONG:
        away = (x * x).sum(axis=1)[:, None] - 2 * exact.matmul(x, np.ascontiguousarray(entries.T))
        away += (entries * entries).sum(axis=1)[None]
        code = away.argmin(axis=1)
        return code, away[np.arange(len(x)), code]
    code, best = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    wide = entries.astype(object)
    for i, row in enumerate(x.astype(object)):
        away = ((wide - row) ** 2).sum(axis=1)
        code[i] = away.argmin()
        best[i] = away[code[i]]
    return code, best


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(part) for part in np.split(x, parts, axis=1)]


def start(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, position) of the rows with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    x = exact.scaled(np.array([row.v for row in first], float).reshape(-1, d))
    return np.array(_cut(x, parts))


def step(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = np.zeros((parts, entries), np.int64)
        high = np.zeros((parts, entries, width), np.int64)
        low = np.zeros((parts, entries, width), np.int64)
        for _, v in vectors.blocks(batches, 0, parts * width):
            for p, x in enumerate(_cut(exact.scaled(v), parts)):
                code, _ = nearest(x, books[p])
                count[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                to = code[order[first]]
                high[p][to] += np.add.reduceat(x[order] >> 32, first, axis=0)
                low[p][to] += np.add.reduceat(x[order] & 0xFFFFFFFF, first, axis=0)
        used = np.flatnonzero(count.ravel())
        cells = (used[:, None] * width + np.arange(width)).ravel()
        columns = [cells, np.repeat(count.ravel()[used], width), high.ravel()[cells], low.ravel()[cells]]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["cell", "n", "high", "low"])

    sums = rows.select("v").mapInArrow(add_up, "cell long, n long, high long, low long")
    # One row per component of the codebooks.
    totals = sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()
    out = books.copy()
    flat = out.reshape(-1)
    for cell in totals:
        flat[cell.cell] = exact.whole(cell.high, cell.low) // cell.n
    return out


def codebooks(
    rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray:
    """Codebooks (part, entry, position) of the rows of ``kept``."""
    if d % parts:
        raise ValueError(f"{parts} parts do not divide {d} components")
    books = start(rows, d, parts, entries)
    if books.size:
        for _ in range(rounds):
            books = step(rows, books)
    return books


def compress(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (array of int), error: a row per row of ``kept``."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch, v in vectors.blocks(batches, 2, parts * width):
            found = [nearest(x, books[p]) for p, x in enumerate(_cut(exact.scaled(v), parts))]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.int32)
            errors = sum(away.astype(object) for _, away in found)
            errors = pa.array([int(e) if e <= exact.LONG else None for e in errors], pa.int64())
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * parts, codes.ravel())
            yield pa.record_batch([batch.column(0), batch.column(1), lists, errors], names=["vec_id", "label", "codes", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(
        assign, f"vec_id long, label {label}, codes array<int>, error long"
    )


def restore(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Vectors (still times 1024) that codes (row, part) stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the sum of ``error`` over their label; nulls are one label.

    A label's rows add up in their partitions first, and its total is joined to each of its
    salted groups, so that a label with a third of all rows meets in no one task.
    """
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(F.count("error") == F.count(F.lit(1)), total)
    totals = coded.groupBy("label").agg(whole.alias("total"))
    totals = totals.select(
        F.col("label").alias("of"),
        F.when(F.abs("total") <= F.lit(exact.LONG), F.col("total")).cast("long").alias("label_error"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"),
    )
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    same = salted["label"].eqNullSafe(totals["of"]) & (salted["salt"] == totals["at"])
    return salted.join(totals, same).drop("of", "at", "salt")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of ``embeddings``."""
    rows = kept(common.table(spark, sf_dir, "embeddings"))
    d = vectors.dimension(rows, "v")
    if not d:
        return spark.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    books = codebooks(rows, d)
    coded = with_label_error(common.durable(compress(rows, books)))
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The rounds, one after the other: nearest entries ``a``, then codebooks ``b``."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""
a{k} AS MATERIALIZED (
  SELECT pid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.pid, x.p, b.e, x.s - 2 * list_inner_product(x.q, b.q) + list_inner_product(b.q, b.q) AS d
    FROM parts x JOIN b{k} b ON x.p = b.p)
  GROUP BY pid, p)""")
        if k < ROUNDS:
            out.append(f"""
s{k} AS (
  SELECT p, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT a.p, a.e, unnest(range(len(x.q))) AS i, unnest(x.q)::BIGINT AS c
    FROM a{k} a JOIN parts x ON x.pid = a.pid AND x.p = a.p)
  GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS q FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.q, b.q) AS q FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)""")
    return ",".join(out)


#: Exact as long as squared distances stay below 2^53.
ORACLE = f"""
WITH sound AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS pid, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT pid, p, q, list_inner_product(q, q) AS s FROM (
    SELECT pid, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS q
    FROM sound, (SELECT unnest(range({PARTS})) AS p))),
b0 AS MATERIALIZED (SELECT p, pid - 1 AS e, q FROM parts WHERE pid <= {ENTRIES}),{_rounds_sql()},
coded AS (
  SELECT pid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY pid),
book AS (
  SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS digest FROM (
    SELECT p, e, array_to_string(list_transform(q, lambda x: x::BIGINT), ',') AS c FROM b{ROUNDS}))
SELECT s.vec_id, c.code, c.error,
  CAST(sum(c.error) OVER (PARTITION BY s.label) AS BIGINT) AS label_error, b.digest AS codebooks_sha256
FROM sound s JOIN coded c ON c.pid = s.pid CROSS JOIN book b
"""
