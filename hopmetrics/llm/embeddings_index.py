"""Approximate nearest neighbours with a permutation index.

``PIVOTS`` vectors of a bounded sample are pivots. Every vector is represented by its
``PREFIX`` nearest pivots in order of distance, and posted to the inverted file of each of
them with the pivot's rank. A query opens the files of its own nearest pivots; the ranks
met there add up to the footrule distance of the two orders (a pivot missing in one of
them counts as rank ``PREFIX`` there). The ``SHARE`` of all entries with the smallest
footrule are reranked with their original vectors.

The files are kept in blocks of bounded size: a block holds the postings of some entries
to all pivots. So a pivot near a third of all vectors is spread over all blocks, and the
best of each block, in proportion to its size, go to the reranking. Equal vectors are one
entry with its smallest ids: more than ``k + 1`` of them can be in no result.

Cases: null, zero and non-finite vectors, and those holding a null, take no part; nor do
those with another number of components than most have (of equally many the smaller
number). Repeated rows are one. With fewer than ``k`` candidates all are returned. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common

PIVOTS = 128
#: Vectors that pivots are taken from: those with the smallest hash.
PIVOT_SAMPLE = 1024
PREFIX = 96
#: The part of each block that is reranked, and the least number.
SHARE, LEAST = 0.15, 300
NEIGHBOURS = 10
EVERY = 100
#: Entries in a block of the inverted files, and queries that a block answers at once.
BLOCK, QUERIES = 4096, 64


def entries(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """entry, v (array of double), ids (ascending; the k + 1 smallest): a row per distinct vector."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & sound & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").head(1)
    rows = rows.filter(F.size("v") == (sizes[0].n if sizes else 0))
    # -0.0 is 0.0; equal vectors meet in two steps, each keeping the smallest ids only, so that
    # a vector with a third of all rows is spread over many groups first.
    plain = rows.select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v")).distinct()
    salted = plain.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(
        F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("some")
    )
    grouped = salted.groupBy("v").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("ids"),
    )
    return common.durable(grouped.withColumn("entry", F.monotonically_increasing_id()))


def pivots(index: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots far from each other, from a bounded sample."""
    rows = index.orderBy(F.xxhash64("v"), "entry").limit(sample).select("v").collect()
    points = np.array([r.v for r in rows], float)
    if len(points) <= count:
        return points
    chosen = [0]
    away = _distances(points, points[:1])[:, 0]
    while len(chosen) < count:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances up to rounding."""
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]


def orders(x: np.ndarray, points: np.ndarray, prefix: int) -> np.ndarray:
    """Rank of each pivot for each vector; ``prefix`` for those beyond it."""
    near = np.argsort(_distances(x, points), axis=1, kind="stable")[:, :prefix]
    ranks = np.full((len(x), len(points)), min(prefix, len(points)), np.int16)
    np.put_along_axis(ranks, near, np.arange(near.shape[1], dtype=np.int16)[None], axis=1)
    return ranks


def inverted(ranks: np.ndarray, prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot its file: entries that have it among their nearest, and its rank there."""
    return [((at := np.flatnonzero(column < prefix)), column[at]) for column in ranks.T]


def footrules(query: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], size: int, prefix: int) -> np.ndarray:
    """Footrule distance of a query's order to those of all entries of a block.

    Over all pivots that is the sum of |rank - rank|; what an entry adds for a pivot out of
    its own prefix is known beforehand, so only the files of the query's pivots are read,
    and each entry's ranks in other files count as ``prefix`` less the rank.
    """
    total = np.zeros(size, np.int64)
    opened = np.flatnonzero(query < prefix)
    total += int((prefix - query[opened].astype(np.int64)).sum())  # as if it shared none
    for pivot in opened:
        at, rank = files[pivot]
        # Instead of (prefix - q) for a missing pivot: |q - r|, and the entry's own rest.
        q = int(query[pivot])
        total[at] += np.abs(rank - q) - (prefix - q) - (prefix - rank)
    return total


def search(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each vector whose id ``every`` divides."""
    index = entries(vectors, k)
    points = pivots(index)
    spark = vectors.sparkSession
    if not len(points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    prefix = min(PREFIX, len(points))
    shared = spark.sparkContext.broadcast(points)
    # Every id is a query of its own, though equal vectors are one entry.
    v = F.col("embedding").cast("array<double>")
    asked = (
        vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.transform(v, lambda x: x + 0.0).alias("v"))
        .filter(F.col("query_id") % every == 0)
        .distinct()
        .join(index.select("v", "entry"), "v")
        .select("query_id", "v", "entry")
    )
    asked = common.durable(asked)
    distinct = asked.select("entry", "v").dropDuplicates(["entry"]).withColumnRenamed("entry", "query")

    # Blocks of entries; every block answers every group of queries.
    n = index.count()
    blocks = max(1, -(-n // BLOCK))
    groups = max(1, -(-distinct.count() // QUERIES))
    left = index.select("entry", "v", F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block"))
    right = distinct.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("part"))
    packed = right.groupBy("part").agg(F.collect_list("query").alias("queries"), F.flatten(F.collect_list("v")).alias("qv"))
    tasks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            points = shared.value
            block = block.sort_values("entry")
            x = np.array(block["v"].tolist(), float)
            ids = block["entry"].to_numpy()
            files = inverted(orders(x, points, prefix), prefix)
            rest = np.zeros(len(x), np.int64)  # what each entry adds for all its pivots
            for at, rank in files:
                rest[at] += prefix - rank
            depth = min(len(x), max(-(-LEAST // blocks), int(np.ceil(share * len(x))), k + 1))
            for queries, flat in zip(asked["queries"], asked["qv"], strict=True):
                y = np.array(flat, float).reshape(len(queries), -1)
                for i, ranks in enumerate(orders(y, points, prefix)):
                    away = footrules(ranks, files, len(x), prefix) + rest
                    best = np.argpartition(away, depth - 1)[:depth]
                    exact = np.sqrt(((x[best] - y[i]) ** 2).sum(1))
                    # A block's k + 1 nearest are all that can be among the nearest of all.
                    near = np.lexsort((ids[best], exact))[: k + 1]
                    cut = exact[near[-1]]
                    near = np.flatnonzero(exact <= cut)
                    out.append(pd.DataFrame({"query": queries[i], "entry": ids[best][near], "score": exact[near]}))
        if not out:
            return pd.DataFrame({"query": [], "entry": [], "score": []}).astype({"query": "int64", "entry": "int64"})
        return pd.concat(out)

    found = (
        left.groupBy("block")
        .cogroup(tasks.groupBy("block"))
        .applyInPandas(answer, "query long, entry long, score double")
    )
    # Per query a few rows of every block, brought down to those that can be in the result.
    ranked = (
        found.join(index.select("entry", "ids"), "entry")
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("score", "ids"))).alias("near"))
    )
    best = F.slice("near", 1, k + 1)
    # The slice may end within vectors equally near: all of those stay.
    kept = F.filter("near", lambda c: c["score"] <= F.element_at(best, -1)["score"])
    pairs = F.flatten(
        F.transform(kept, lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id"))))
    )
    own = F.filter("pairs", lambda c: c["vec_id"] != F.col("query_id"))
    return (
        asked.select("query_id", F.col("entry").alias("query"))
        .join(ranked.select("query", pairs.alias("pairs")), "query")
        .select("query_id", F.posexplode(F.slice(F.array_sort(own), 1, k)).alias("rank", "c"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), "c.vec_id", "c.score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
