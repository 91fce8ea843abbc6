"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function serves all: a document's sketch holds the ``K`` smallest of its shingle
hashes. Documents with equal shingle sets are one node from here on. Inverted lists of
retained values bring nodes together; the sketch of the union estimates a pair's
similarity, and the full sets of those that may reach the threshold are compared.

Completeness. Two sets with similarity ``THRESHOLD`` share at least ``least_shared(size)``
retained values (exactly so for sets within a sketch, else but for one pair in 1e7 at the
threshold itself). So it is enough to post ``size - least_shared(size) + 1`` values of
each sketch, if all sketches are cut in one order; the order puts frequent values last,
which keeps passages that many documents share out of the lists.

Skew. Lists are never paired in full at first: a list's members are compared with
its hubs, those that are first in one of ``ORDERS``, estimate first, and the similar ones become components. A pair within a
component changes nothing any more. Lists that still hold several components are compared
one by one, large ones by pairs of blocks, on a bitmap of each sketch that bounds what two
can share from above. What may be similar leaves as pairs, for the estimate and then the
full sets; where a list has many such pairs it leaves as members instead, which one task
compares on full sets, returning a forest of links. Such lists of much the same members are put
together first, as long as they fit in a block. So rows stand for members, and for a few
pairs each, and no link that matters is lost.

Cases: a null or blank text has no shingles, is linked with nothing, and is kept. Rows
with one ``doc_id`` count as one document in the ids of components, and in ``kept`` of
``report``; null ids come last and are reported as null. ``dedup`` judges each row by its own
text, so rows that share an id, or have none, stay or go independently. Other columns, whatever
their names, are ignored by ``components`` and passed on by ``dedup``. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopmetrics.llm import common, words

K = 96
#: Similarity in per cent: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: A list's hubs are its smallest members after an exclusive or with each of these.
ORDERS = (0, 2**63 - 1, 0x2AAAAAAAAAAAAAAA)
#: Members of a list in a block; larger lists are compared block by block.
BLOCK = 2000
#: Bits of a node's bitmap.
BITS = 1024
#: Pairs for each member, on average, from which a list is compared in one task on full sets.
DENSE = 4
#: Bits of the bitmap of wanted rows; it is broadcast in 64-bit words, SIEVE / 64 at most.
SIEVE = 2**24
#: At most so many values are known as frequent.
FREQUENT = 20_000


@cache
def least_shared(size: int, k: int = K, percent: int = THRESHOLD) -> int:
    """Retained values that a similar pair shares, by the number of values retained of one."""
    if size * 100 < k * percent:  # a similar set fits into a sketch as well
        return -(-size * percent // 100)
    # The union's smallest values are shared ones with the odds of the similarity.
    p, total = percent / 100, 0.0
    for t in range(size + 1):
        total += comb(size, t) * p**t * (1 - p) ** (size - t)
        if total > 1e-7:
            return max(t, 1)
    return 1


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc, body, n (shingles), h1, h2 (hash of the set), sketch (the k smallest, as bytes)."""
    schema = pa.schema([("doc", pa.int64()), ("body", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget_kept()
        for batch in batches:
            for part in _parts(batch):
                sets = words.shingle_sets(part.column(1))
                h1, h2 = _set_hashes(sets)
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.array([s[:k].tobytes() for s in sets], pa.binary()),
                    ],
                    schema=schema,
                )

    text = common.text_or_empty()
    source = docs.select(common.doc_key().alias("doc"), text.alias("text"), F.xxhash64(text).alias("body"))
    return source.mapInArrow(run, "doc long, body long, n long, h1 long, h2 long, sketch binary")


def _parts(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about that many bytes of text (column 1) each."""
    _, begin = words.utf8(batch.column(1))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([words._mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def _frequent(nodes: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent values, ascending, and their counts; no more than ``most`` of them.

    Counted in two steps; what occurs once in a batch does not leave its task. The counts
    only order values, and any order serves, so that they may lack one per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            values, counts = np.unique(joined, return_counts=True)
            yield pa.record_batch([pa.array(values[counts > 1]), pa.array(counts[counts > 1])], names=["value", "n"])

    total = nodes.agg(F.sum(F.octet_length("sketch")).alias("n")).first().n or 0
    least = max(16, total // 8 // most + 1)  # at most total / least values occur so often
    counts = nodes.select("sketch").mapInArrow(run, "value long, n long")
    rows = counts.groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
    rows.sort()
    return np.array([r.value for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def _postings(nodes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """value, node, n: the values of each sketch that come first, the frequent ones being last."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        for batch in batches:
            ids, sizes, sketches = (c.to_pylist() for c in batch.columns)
            chosen = []
            for sketch in sketches:
                values = np.frombuffer(sketch, np.int64)
                order = np.zeros(len(values), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                    order = np.where(often[at] == values, counts[at], 0)
                length = len(values) - least_shared(len(values), k, percent) + 1
                chosen.append(values[np.lexsort((values, order))[:length]])
            times = [len(c) for c in chosen]
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(chosen) if chosen else np.zeros(0, np.int64)),
                    pa.array(np.repeat(np.array(ids, np.int64), times)),
                    pa.array(np.repeat(np.array(sizes, np.int64), times)),
                ],
                names=["value", "node", "n"],
            )

    return nodes.select("node", "n", "sketch").mapInArrow(run, "value long, node long, n long")


def _met(postings: DataFrame) -> DataFrame:
    """value, node, n, hubs (nodes) of the values of more than one sketch.

    Counted alone first: most values are in one sketch only, and go no further. A list's hubs
    are found by the way, so that no later step has to bring a list together for them.
    """
    firsts = [F.min(F.col("node").bitwiseXOR(F.lit(o))).alias(f"hub{i}") for i, o in enumerate(ORDERS)]
    hubs = F.array_distinct(F.array(*(F.col(f"hub{i}").bitwiseXOR(F.lit(o)) for i, o in enumerate(ORDERS))))
    often = postings.groupBy("value").agg(F.count("*").alias("c"), *firsts).filter("c > 1")
    return postings.join(often.select("value", hubs.alias("hubs")), "value")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sieved(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """All rows with wanted keys, and few others while there are few wanted ones.

    A bitmap of a fixed size, so that rows that nobody wants are not shuffled for a join. An
    exact join has to follow.
    """
    mark = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("mark", F.lit(64)).cast("int"))
    marks = (
        wanted.select(mark.alias("mark"))
        .groupBy(F.shiftright("mark", 6).alias("word"))
        .agg(F.bit_or(bit).alias("marks"))
    )
    return (
        rows.withColumn("mark", mark)
        .withColumn("word", F.shiftright("mark", 6))
        .join(F.broadcast(marks), "word")
        .filter(F.getbit("marks", F.pmod("mark", F.lit(64)).cast("int")) == 1)
        .drop("mark", "word", "marks")
    )


def _texts_of(pairs: DataFrame) -> DataFrame:
    """doc, body of both members of each pair, repeats included."""
    one, other = (F.struct(F.col(f"{c}_doc").alias("doc"), F.col(f"{c}_body").alias("body")) for c in "ab")
    return pairs.select(F.explode(F.array(one, other)).alias("row")).select("row.*")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, body, full: the whole shingle set of each wanted text (doc, body), and of few others, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = words.shingle_sets(part.column(1))
                full = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.record_batch([part.column(0), part.column(2), full], names=["doc", "body", "full"])

    text = common.text_or_empty()
    texts = docs.select(common.doc_key().alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    texts = _sieved(texts, wanted, "doc", "body")
    once = texts.groupBy("doc", "body").agg(F.first("text").alias("text"))  # repeated rows are one
    return once.select("doc", "text", "body").mapInArrow(run, "doc long, body long, full binary")


_PAIR = "a long, a_doc long, a_body long, b long, b_doc long, b_body long"


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of similar sizes whose union sketch has enough shared values to reach the threshold.

    Gives each member's text (doc, body) as well, so that full sets need no join with the nodes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for i, (x, y) in enumerate(zip(frame["x"], frame["y"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                union = np.union1d(x, y)[:k]
                shared = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
                keep[i] = shared.sum() >= least_shared(len(union), k, percent)
            yield frame.loc[keep, ["a", "a_doc", "a_body", "b", "b_doc", "b_body"]]

    member = nodes.select("node", "doc", "body", "n", "sketch")
    one, other = (member.toDF(c, f"{c}_doc", f"{c}_body", f"{c}_n", s) for c, s in ("ax", "by"))
    joined = pairs.join(one, "a")
    if "n" in pairs.columns:  # of b: dissimilar ones take no sketch along to the next join
        joined = joined.filter(_similar_sizes(F.col("n"), F.col("a_n"), percent)).drop("n")
    return joined.join(other, "b").drop("a_n", "b_n").mapInPandas(run, _PAIR)


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for i, (x, y) in enumerate(zip(frame["x"], frame["y"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield frame.loc[keep, ["a", "b"]]

    one, other = (full.toDF(f"{c}_doc", f"{c}_body", s) for c, s in ("ax", "by"))
    joined = pairs.join(one, ["a_doc", "a_body"]).join(other, ["b_doc", "b_body"])
    return joined.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of all nodes with an edge (a, b).

    Links lead from larger nodes to smaller ones. In turn, what a node is linked with moves to
    the smallest of it, and a link to a node that has links itself goes to the smallest of
    those instead, until all nodes are linked with one that has no link. Each step is
    written down, so that the lineage stays short.
    """
    links, before = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), None
    while True:
        least = F.min("v").over(Window.partitionBy("u"))
        own = links.repartition("u").dropDuplicates(["u", "v"]).withColumn("m", least)
        hooked = own.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        above = hooked.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("to"))
        # Repeats are dropped where the join has put them.
        moved = hooked.join(above, "v", "left").dropDuplicates(["u", "v"])
        links = common.durable(moved.select("u", F.coalesce("to", "v").alias("v")))
        if before is not None:
            common.forget(before)
        before = links
        # As an end of links: what it leads to, at least and at most, and whether others lead to it.
        child, parent = F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))
        end = F.explode(F.array(child, parent))
        ends = (
            links.select(end.alias("end"))
            .groupBy("end.node")
            .agg(F.min("end.to").alias("low"), F.max("end.to").alias("high"), F.max(F.isnull("end.to")).alias("met"))
        )
        ends = common.durable(ends)
        if not ends.filter("low < high or low is not null and met").count():
            common.forget(links)
            return ends.select("node", F.coalesce("low", "node").alias("label"))
        common.forget(ends)


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and of all their intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = np.zeros((len(sets), len(sets)), np.int64)
    step = 4096  # columns at once
    order = np.argsort(index, kind="stable")
    # Values of one set only count for nothing.
    often = np.bincount(index) > 1
    column = np.cumsum(often) - 1
    keep = order[often[index[order]]]
    rows, columns = rows[keep], column[index[keep]]
    for low in range(0, int(often.sum()), step):
        a, b = np.searchsorted(columns, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)
        part[rows[a:b], columns[a:b] - low] = 1
        shared += np.rint(part @ part.T).astype(np.int64)
    return sizes, shared


def _forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets, as a forest."""
    sizes, shared = _shared(sets)
    union = sizes[:, None] + sizes[None] - shared
    similar = np.triu(100 * shared >= percent * union, 1)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x, y in zip(*np.nonzero(similar), strict=True):
        rx, ry = root(int(x)), root(int(y))
        if rx != ry:
            parent[rx] = ry
            links.append((int(x), int(y)))
    return links


def _bitmaps(nodes: DataFrame) -> DataFrame:
    """node, bits: a bit for each retained value, by its last digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [np.frombuffer(s, np.uint64) for s in batch.column(1).to_pylist()]
            marked = np.zeros((len(sketches), BITS), bool)
            rows = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
            if len(rows):
                marked[rows, np.concatenate(sketches) % np.uint64(BITS)] = True
            packed = np.packbits(marked, axis=1)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=["node", "bits"])

    return nodes.select("node", "sketch").mapInArrow(run, "node long, bits binary")


def _pairs_within(begin: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of all pairs within runs of rows (``begin``, one more for the end), some at a time."""
    rows = np.arange(begin[-1])
    partners = np.repeat(begin[1:], np.diff(begin)) - rows - 1
    upto = np.concatenate([[0], np.cumsum(partners)])
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + most, "right")) - 1)
        some = partners[low:high]
        x = np.repeat(rows[low:high], some)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(upto[low:high] - upto[low], some)
        low = high


def _candidates(frame: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Of lists (value, i, j), what their members may have in common with other components'.

    Two sketches share at most as many values as their bitmaps share bits, and those that
    fell on one bit in either. Gives pairs (list null, a, b); where a list has many more
    pairs than members, instead its members that are in one (list, alike, a, b null), for a task of
    their own. ``alike`` is the same for lists with the same first member in the order of a hash,
    which most lists of much the same members have.
    """
    frame = frame.sort_values(["value", "i", "j", "node"], ignore_index=True)
    lists = frame[["value", "i", "j"]].to_numpy()
    begin = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]).any(axis=1), True]) if len(frame) else np.zeros(1, int)
    node, n, label, at = (frame[c].to_numpy() for c in ("node", "n", "label", "at"))
    bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), -1)
    size = np.minimum(n, k)
    slack = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    least = np.array([least_shared(c, k, percent) for c in range(k + 1)])[size]
    apart = frame["i"].to_numpy() != frame["j"].to_numpy()
    found = [(np.zeros(0, np.int64),) * 2]
    for x, y in _pairs_within(begin, 1_000_000):
        near = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        near &= ~apart[x] | (at[x] != at[y])  # pairs within a block have their own task
        x, y = x[near], y[near]
        shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(slack[x], slack[y])
        near = shared >= np.minimum(least[x], least[y])
        found.append((x[near], y[near]))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    of = np.searchsorted(begin, x, "right") - 1
    dense = np.bincount(of, minlength=max(len(begin) - 1, 1)) > DENSE * np.diff(begin) if len(begin) > 1 else np.zeros(1, bool)
    few = ~dense[of]
    out = [pd.DataFrame({"a": np.minimum(node[x], node[y])[few], "b": np.maximum(node[x], node[y])[few]})]
    for i in np.flatnonzero(dense):
        members = np.unique(node[np.concatenate([x[of == i], y[of == i]])])
        # Lists with the same members are one task.
        hashes = words._mix(members.view(np.uint64))
        key = hashes.sum(dtype=np.uint64).view(np.int64)
        place = np.array([lists[begin[i], 1] * BLOCK + lists[begin[i], 2]]).view(np.uint64)
        alike = (hashes.min() ^ words._mix(place)).view(np.int64)[0]
        out.append(pd.DataFrame({"list": key, "alike": alike, "a": members}))
    columns = ["list", "alike", "a", "b"]
    return pd.concat(out).reindex(columns=columns).astype(dict.fromkeys(columns, "Int64")).drop_duplicates()


def _list_candidates(rest: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """list, alike, a, b of ``_candidates`` for all lists; rest: value, node, n, label, c (members of the list)."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(_bitmaps(nodes), "node").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select(
        "value", "node", "n", "label", "at", "bits", "blocks",
        F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"),
    )
    # Small lists share a task, as many as make a block; blocks of larger ones have their own.
    tasks = max(1, -(-rest.count() // BLOCK))
    small = F.col("blocks") == 1
    task = F.when(small, F.pmod(F.xxhash64("value"), F.lit(tasks))).otherwise(F.xxhash64("value", "i", "j"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _candidates(frame, k, percent)

    dealt = dealt.withColumns({"small": small, "task": task}).drop("blocks")
    return dealt.groupBy("small", "task").applyInPandas(run, "list long, alike long, a long, b long")


def _put_together(dense: DataFrame) -> DataFrame:
    """list, node: the members of dense lists (list, alike, node), alike ones as one where a block holds them."""
    members = dense.select("alike", "node").distinct()
    fits = members.groupBy("alike").agg(F.count("*").alias("c")).filter(F.col("c") <= BLOCK)
    key = F.when(F.col("c").isNotNull(), F.col("alike")).otherwise(F.col("list"))
    return dense.join(fits, "alike", "left").select(key.alias("list"), "node").distinct()


def _dense_links(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the similar members of each list; members: list, node, doc, body."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        nodes = frame["node"].to_numpy()
        links = _forest([np.frombuffer(s, np.uint64) for s in frame["full"]], percent) if len(frame) > 1 else []
        return pd.DataFrame({"a": [nodes[x] for x, _ in links], "b": [nodes[y] for _, y in links]}, dtype="int64")

    sets = members.join(full, ["doc", "body"]).select("list", "node", "full")
    return sets.groupBy("list").applyInPandas(run, "a long, b long")


def _placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc, body, n, first of each row: the smallest (doc, body) of its component, null for blank texts."""
    sketches = common.durable(_sketches(docs, k))
    # Equal sets have equal sketches, so it does not matter whose is taken.
    nodes = common.durable(
        sketches.filter("n > 0")
        .groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("doc", "body")).alias("row"), F.first("sketch").alias("sketch"))
        .select("h1", "h2", "n", "row.*", "sketch", F.monotonically_increasing_id().alias("node"))
    )
    rows = common.durable(sketches.select("doc", "body", "n", "h1", "h2"))
    common.forget(sketches)
    met = common.durable(_met(_postings(nodes, _frequent(nodes, FREQUENT), k, percent)))
    starred = met.select(F.explode("hubs").alias("a"), F.col("node").alias("b"), "n").filter("a <> b")
    near = common.durable(_estimated(starred.distinct(), nodes, k, percent))  # a pair meets in many lists
    full = common.durable(_full_sets(docs, _texts_of(near)))
    links = common.durable(_verified(near, full, percent))
    common.forget(full)
    labels = connected(links)

    # Lists with nodes in several components that have not been compared as hubs.
    rest = met.filter(~F.array_contains("hubs", F.col("node"))).select("value", "node", "n").join(labels, "node", "left")
    rest = rest.withColumn("label", F.coalesce("label", "node"))
    still = (
        rest.groupBy("value")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"))
        .filter("low < high")
    )
    rest = common.durable(rest.join(still.select("value", "c"), "value").select("value", "node", "n", "label", "c"))
    common.forget(met)
    if not rest.isEmpty():
        found = common.durable(_list_candidates(rest, _sieved(nodes, rest, "node"), k, percent).distinct())
        pairs = found.filter("list is null").select("a", "b")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        near = common.durable(_estimated(pairs, _sieved(nodes, ends, "node"), k, percent))
        dense = _put_together(found.filter("list is not null").select("list", "alike", F.col("a").alias("node")))
        dense = common.durable(dense.join(nodes.select("node", "doc", "body"), "node"))
        full = common.durable(_full_sets(docs, _texts_of(near).unionByName(dense.select("doc", "body"))))
        links = common.durable(_verified(near, full, percent).unionByName(_dense_links(dense, full, percent)))
        common.forget(full)
        if not links.isEmpty():
            labels = connected(labels.toDF("a", "b").unionByName(links))
    grouped = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min(F.struct("doc", "body")).alias("first"))
    by_set = common.durable(grouped.join(smallest, "label").select("h1", "h2", "n", "first"))
    common.forget(nodes)
    return rows.join(by_set, ["h1", "h2", "n"], "left").select("doc", "body", "n", "first")


def components(docs: DataFrame, k: int = K, percent: int = THRESHOLD) -> DataFrame:
    """doc, n_shingles, component of each row; ``doc`` and ``component`` as ``common.doc_key``."""
    return _placed(docs, k, percent).select(
        "doc", F.col("n").alias("n_shingles"), F.coalesce("first.doc", "doc").alias("component")
    )


def _id(doc: Column) -> Column:
    return F.when(doc != common.NO_ID, doc)


def report(docs: DataFrame, k: int = K, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return components(docs, k, percent).select(
        _id(F.col("doc")).alias("doc_id"),
        "n_shingles",
        _id(F.col("component")).alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )


def dedup(docs: DataFrame, k: int = K, percent: int = THRESHOLD) -> DataFrame:
    """One row, with its columns, of each component; blank texts all stay.

    The row with the smallest id stays; of several texts with that id the one with the
    smallest hash, and of repeated rows of it one.
    """
    placed = _placed(docs, k, percent).filter("first is not null")
    keys = placed.groupBy("doc", "body").agg(
        F.count("*").alias("c"), F.first(F.struct("doc", "body") == F.col("first")).alias("stays")
    )
    keys = common.durable(keys.filter("c > 1 or not stays"))
    rows = docs.select(
        F.struct("*").alias("row"), common.doc_key().alias("doc"), F.xxhash64(common.text_or_empty()).alias("body")
    )
    alone = rows.join(keys, ["doc", "body"], "left_anti").select("row.*")
    often = keys.filter("stays").select("doc", "body")
    if often.isEmpty():
        return alone
    # Numbered once and written, so that the same one of the repeated rows stays in every run.
    numbered = rows.join(often, ["doc", "body"], "left_semi").withColumn("at", F.monotonically_increasing_id())
    one = common.durable(numbered).groupBy("doc", "body").agg(F.min_by("row", "at").alias("row"))
    return alone.unionByName(one.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))
