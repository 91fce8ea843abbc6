"""Repeated byte strings, removed: every byte of a ``SPAN``-byte string that starts anywhere else.

Shard Burrows-Wheeler transforms, merged by refining how the shards interleave.

1. Windows of ``SPAN`` bytes are dealt out by content: a window's anchor is the string in it,
   of the first size of ``ANCHORS``, with the smallest hash (the last of equal ones). Equal
   windows have equal anchors at equal places. Anchors that occur once are dropped, so only
   stretches that may repeat go on. Equal surroundings of an anchor are one occurrence
   with their number; two or more of them are repeated as a whole.
2. The occurrences of an anchor, with the bytes around it, stand aligned below each other (a
   bin), so that suffixes are compared from the same column on only. Shards of ``SHARD`` rows are
   transformed each by itself: a column of the transform holds the characters before the sorted
   suffixes of the next one (``transform``).
3. The transforms are merged without looking at a suffix again (``merge``): which shard each
   merged suffix is from is refined column by column. The interleaving of one column says
   where each shard's next character goes, and a stable sort of these characters gives the
   interleaving of the next. Common prefixes come with it: one more than the least in between
   where the characters are the same.
4. At each column, neighbours with a common prefix of ``SPAN`` or more are a repeated interval.
   These starts, put together by document, give the bytes to remove.

A task merges bins of at most ``MOST`` distinct occurrences. The windows of larger ones are dealt
out again, by the same steps, with anchors of the next size; the last is the window itself, of
which a bin holds one.

Cases: null texts are empty. A text's own repetitions count, overlapping ones too. Texts
shorter than ``SPAN`` bytes keep all. Rows with the same ``doc_id`` are documents of their
own. Empty tables give an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common, words

SPAN = 200
#: Sizes of anchors: the first for all windows, the next for those of bins over ``MOST``.
ANCHORS = (40, 120, 180, SPAN)
#: Most anchor strings in a window.
WIDTH = SPAN - ANCHORS[0] + 1
#: Distinct occurrences of an anchor that one task merges.
MOST = 10_000
#: Rows of bins that are merged at once, and rows of a shard.
ROWS, SHARD = 10_000, 2_500


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more for the end)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, for the places that have as many."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    powers = words._powers(words._BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words._BYTE[raw] * powers[:n], out=sums[1:])
    back = words._powers(words._INVERSE, n - size + 1)
    return words._mix((sums[size:] - sums[:-size]) * back)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values in a row, the last of equal ones."""
    n = len(values) - width + 1
    # Blocks of the width: least from the left in the next block, from the right in this one.
    size = -(-len(values) // width) * width
    # Ties go to the last place: of equal values the right one is taken below.
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, 1)
    at = np.arange(size).reshape(-1, width)
    place_left = np.maximum.accumulate(np.where(grid == left, at, -1), 1)
    flipped = grid[:, ::-1]
    right = np.minimum.accumulate(flipped, 1)
    fresh = np.ones_like(flipped, bool)
    fresh[:, 1:] = flipped[:, 1:] < right[:, :-1]
    # From the right, the first place with the least is the last of equal ones.
    order = np.maximum.accumulate(np.where(fresh, np.arange(width)[None], 0), 1)
    place_right = (at[:, ::-1][np.arange(len(grid))[:, None], order])[:, ::-1]
    right = right[:, ::-1]
    start = np.arange(n)
    end = start + width - 1
    rv, rp = right.ravel()[start], place_right.ravel()[start]
    lv, lp = left.ravel()[end], place_left.ravel()[end]
    return np.where(lv <= rv, lp, rp)


def anchors(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window start of each anchor of ``size`` bytes of a text."""
    if len(raw) < SPAN:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = _rolling(raw, size)
    place = _window_minima(hashes, SPAN - size + 1)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(place)]]) - 1
    at = place[first]
    return hashes[at], at, first, last


def _keyed(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty()
    return docs.select(
        common.doc_key().alias("doc"),
        F.xxhash64(text).alias("body"),
        text.cast("binary").alias("text"),
        F.lit(1).cast("long").alias("n"),
    )


def _anchor_hashes(rows: DataFrame, size: int) -> DataFrame:
    """doc, body, anchor: the distinct anchors of each row, with ``n``, how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin = _bytes(batch.column(2))
            found = [
                np.unique(anchors(raw[a:b], size)[0], return_counts=True)
                for a, b in zip(begin[:-1], begin[1:], strict=True)
            ]
            found = [(h, c * n) for (h, c), n in zip(found, batch.column(3).to_numpy(), strict=True)]
            times = [len(h) for h, _ in found]
            yield pa.record_batch(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), times)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), times)),
                    pa.array(np.concatenate([h for h, _ in found]).view(np.int64) if found else [], pa.int64()),
                    pa.array(np.concatenate([c for _, c in found]) if found else [], pa.int64()),
                ],
                names=["doc", "body", "anchor", "n"],
            )

    return rows.mapInArrow(run, "doc long, body long, anchor long, n long")


def _occurrences(rows: DataFrame, size: int) -> DataFrame:
    """doc, body, n, first, anchor, before, around: the windows of each wanted anchor of a row.

    ``around`` holds the bytes of all windows of the occurrence, ``first`` is its place in
    the text and ``before`` the anchor's place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin = _bytes(batch.column(2))
            wanted = batch.column(4).to_pylist()
            docs, bodies, times = (batch.column(k).to_numpy() for k in (0, 1, 3))
            out: list[list] = [[], [], [], [], [], [], []]
            for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                text = raw[a:b]
                hashes, place, first, last = anchors(text, size)
                hashes = hashes.view(np.int64)
                held = text.tobytes()
                for k in np.flatnonzero(np.isin(hashes, np.array(wanted[i], np.int64))):
                    lo = int(first[k])
                    for column, value in zip(
                        out,
                        (docs[i], bodies[i], times[i], lo, hashes[k], int(place[k]) - lo, held[lo : int(last[k]) + SPAN]),
                        strict=True,
                    ):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc", "body", "n", "first", "anchor", "before", "around"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    schema = "doc long, body long, n long, first long, anchor long, before long, around binary"
    return rows.select("doc", "body", "text", "n", "wanted").mapInArrow(run, schema)


def _by_bin_and_char(bins: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Stable order by bin, then character, of rows whose positions belong to sorted ``bins``."""
    by = np.argsort(chars, kind="stable")
    return by[np.argsort(bins[by], kind="stable")]


@dataclass
class Transform:
    """A shard: by column, characters before the next column's sorted suffixes, and whose suffixes sort where."""

    bins: np.ndarray  # of each rank, ascending
    symbols: np.ndarray  # columns x ranks: 0 for none, or byte + 1, in the order of the column to the right
    rows: np.ndarray  # columns x ranks: the shard's row of each rank


def transform(bins: np.ndarray, chars: np.ndarray) -> Transform:
    """The transform of aligned rows (rows x columns of symbols), right to left."""
    order = np.argsort(bins, kind="stable")
    ranked = bins[order]
    n, width = chars.shape
    out = Transform(ranked, np.empty((width, n), np.uint16), np.empty((width, n), np.uint16))
    for column in range(width - 1, -1, -1):
        symbols = chars[order, column]
        out.symbols[column] = symbols
        order = order[_by_bin_and_char(ranked, symbols)]
        out.rows[column] = order
    return out


def merge(shards: list[Transform]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column, rows in the order of their suffixes there, and common prefixes, right to left.

    Rows are numbered through the shards. The prefix of a rank is what its suffix and the one
    before have in common, at most ``SPAN``; one more entry, 0, ends the list. Only the shards'
    transforms are read: their interleaving is refined from column to column.
    """
    begin = np.cumsum([0] + [len(s.bins) for s in shards])
    bins = np.concatenate([s.bins for s in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), np.diff(begin))
    by_bin = np.argsort(bins, kind="stable")
    bins, shard = bins[by_bin], shard[by_bin]
    n, width = len(bins), len(shards[0].symbols)
    prefix = np.zeros(n + 1, np.int64)
    place = np.empty(n, np.int64)  # of each merged rank among the shards' ranks
    place[np.argsort(shard, kind="stable")] = np.arange(n)
    same_bin = bins[1:] == bins[:-1]
    for column in range(width - 1, -1, -1):
        symbols = np.concatenate([s.symbols[column] for s in shards])[place]
        by = _by_bin_and_char(bins, symbols)
        symbols = symbols[by]
        at = np.flatnonzero(same_bin & (symbols[1:] == symbols[:-1]) & (symbols[1:] > 0))
        new = np.zeros(n + 1, np.int64)
        if len(at):
            between = np.column_stack([by[at] + 1, by[at + 1] + 1]).ravel()
            new[at + 1] = np.minimum(np.minimum.reduceat(prefix, between)[::2] + 1, SPAN)
        prefix, shard = new, shard[by]
        place[np.argsort(shard, kind="stable")] = np.arange(n)
        yield column, np.concatenate([s.rows[column] for s in shards])[place] + begin[shard], prefix


def aligned(before: np.ndarray, around: list[bytes]) -> np.ndarray:
    """Symbols by row and column, the anchors' places in one column: 0 for none, or byte + 1."""
    left = WIDTH - 1 - before
    chars = np.zeros((len(around), max(int(a) + len(x) for a, x in zip(left, around, strict=True))), np.uint16)
    for row, lo, x in zip(chars, left, around, strict=True):
        row[lo : lo + len(x)] = np.frombuffer(x, np.uint8)
        row[lo : lo + len(x)] += 1
    return chars


def interleaved(bins: np.ndarray, before: np.ndarray, around: list[bytes]) -> np.ndarray:
    """Which windows of each occurrence start a string that another one in its bin has too.

    A matrix of bool, a row per occurrence and a column per window.
    """
    n = len(around)
    bins = bins.astype(np.min_scalar_type(int(bins.max())))
    chars = aligned(before, around)
    shards = [transform(bins[k : k + SHARD], chars[k : k + SHARD]) for k in range(0, n, SHARD)]
    repeated = np.zeros(chars.shape, bool)
    del chars
    for column, rows, prefix in merge(shards):
        full = prefix >= SPAN
        repeated[rows, column] = full[:-1] | full[1:]
    out = np.zeros((n, WIDTH), bool)
    for i, x in enumerate(around):
        lo, windows = WIDTH - 1 - before[i], len(x) - SPAN + 1
        out[i, :windows] = repeated[i, lo : lo + windows]
    return out


def _spans(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of covered bytes, in a row."""
    starts = np.flatnonzero(flags)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > SPAN)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])] + SPAN
    return np.column_stack([first, last]).ravel().tolist()


def _bin_spans(distinct: DataFrame) -> DataFrame:
    """c1, c2, spans of the occurrences (anchor, before, around, n) that have a repeated string."""

    def flush(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["anchor"], kind="stable").reset_index(drop=True)
        bins = frame["anchor"].rank(method="dense").to_numpy(np.int64)
        flags = interleaved(bins, frame["before"].to_numpy(np.int64), list(frame["around"]))
        windows = frame["around"].map(len).to_numpy() - SPAN + 1
        often = frame["n"].to_numpy() > 1
        flags[often] = np.arange(WIDTH)[None] < windows[often][:, None]
        return pd.DataFrame({"c1": frame["c1"], "c2": frame["c2"], "spans": [_spans(f) for f in flags]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= ROWS:  # all but the last bin, which may go on
                whole = pd.concat(held)
                last = whole["anchor"] == whole["anchor"].iloc[-1]
                if not last.all():
                    yield flush(whole[~last])
                held, size = [whole[last]], int(last.sum())
        if size:
            yield flush(pd.concat(held))

    sorted_bins = distinct.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_bins.mapInPandas(run, "c1 long, c2 long, spans array<long>").filter(F.size("spans") > 0)


def _repeated(rows: DataFrame, sizes: tuple[int, ...] = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, body, text, n) that may repeat something, and spans (doc, body, spans) in them.

    ``n`` is how often a row's text counts. Anchors have the first of the sizes.
    """
    size = sizes[0]
    hashes = _anchor_hashes(rows, size)
    again = hashes.groupBy("anchor").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor")
    wanted = hashes.join(again, "anchor").groupBy("doc", "body").agg(F.collect_set("anchor").alias("wanted"))
    some = common.durable(rows.join(wanted, ["doc", "body"]))
    found = _occurrences(some, size).withColumns(
        {"c1": F.xxhash64("around"), "c2": F.xxhash64(F.lit(1), "around")}
    )
    distinct = common.durable(
        found.groupBy("anchor", "c1", "c2")
        .agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("around").alias("around"))
    )
    bins = distinct.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    bins = bins.filter("total > 1")
    if len(sizes) == 1:  # a bin holds one window
        spans = _bin_spans(distinct.join(bins.select("anchor"), "anchor"))
    else:
        hot = common.durable(bins.filter(F.col("m") > MOST).select("anchor"))
        spans = _bin_spans(distinct.join(bins.filter(F.col("m") <= MOST).select("anchor"), "anchor"))
        if not hot.isEmpty():
            again_dealt = distinct.join(hot, "anchor").select(
                F.col("c1").alias("doc"), F.col("c2").alias("body"), F.col("around").alias("text"), "n"
            )
            deeper = _repeated(again_dealt, sizes[1:])[1]
            spans = spans.unionByName(deeper.withColumnsRenamed({"doc": "c1", "body": "c2"}))
    at = found.select("doc", "body", "first", "c1", "c2").join(common.durable(spans), ["c1", "c2"])
    moved = F.transform("spans", lambda x: x + F.col("first"))
    return some, at.groupBy("doc", "body").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def cut(raw: bytes, spans: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, and what stays."""
    pairs = sorted(zip(spans[::2], spans[1::2], strict=True))
    kept, runs, upto = [], 0, 0
    end = -1
    for a, b in pairs:
        if a > end:
            runs += 1
            kept.append(raw[max(upto, 0) : a])
        end = max(end, b)
        upto = end
    kept.append(raw[upto:])
    rest = b"".join(kept)
    return len(raw) - len(rest), runs, rest


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) or null where nothing is removed, kept_sha256."""
    some, spans = _repeated(_keyed(docs))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [cut(bytes(t), list(s)) for t, s in zip(frame["text"], frame["spans"], strict=True)]
            yield pd.DataFrame(
                {
                    "doc": frame["doc"],
                    "body": frame["body"],
                    "n_removed": [d[0] for d in done],
                    "n_spans": [d[1] for d in done],
                    "kept": [d[2] for d in done],
                }
            )

    once = some.groupBy("doc", "body").agg(F.first("text").alias("text"))
    changed = once.join(spans, ["doc", "body"]).mapInPandas(
        run, "doc long, body long, n_removed long, n_spans long, kept binary"
    )
    text = common.text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.doc_key().alias("doc"),
        F.xxhash64(text).alias("body"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("whole_sha256"),
    )
    return rows.join(changed, ["doc", "body"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        "kept",
        F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents")).drop("kept")
