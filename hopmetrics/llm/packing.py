"""Packing token sequences by minimum bin slack.

Documents are turned into token ids with an end token each and cut into pieces: full
windows first, the rest (shorter than a window) as one piece. Only the counts of pieces by
length are needed to plan: at most as many rows as a window has tokens. For each window
the plan takes the longest length left and a multiset of the others that fills the
window closest to its capacity: a bitset holds every sum that the lengths reach within
their counts, and the counts taken are read back from the bitsets. The same multiset is
used as often as the counts allow, so every step at least halves the count of a length: the
plan's size follows from the window's, times the logarithm of the number of pieces. Pieces
of a length are numbered across the partitions, and the plan's ranges of numbers say which
sequence and offset each one gets.

Cases: a null text is empty and gives only the end token. Rows with the same ``doc_id`` are
packed each on its own. Texts of any length are read whole. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopmetrics.llm import common

CAPACITY = 4096
END_ID = 2
#: Words kept with their ids in each Python worker; when full, it starts anew.
CACHE_WORDS = 300_000


class _Numbers(dict):
    """Number of each part of a text, given when it is first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        self[part] = number = len(self) + 1
        self.new.append(part)
        return number


#: A letter, one mark, then white space or the end: the tokenizer cuts before the mark.
_MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \t\n\r\x0b\x0c]|\Z)")
#: Lower-case letters of Latin-1 only: such a part is one word of the tokenizer's model.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, part by part.

    The tokenizer takes white space as a border and drops it, so a text's ids are those of
    its parts between ASCII white space in a row, and most parts have been seen before.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        # Part 0 is the end token. Ids of part k are flat[begin[k] : begin[k + 1]].
        self.known = _Numbers()
        self.flat = np.array([self.end_id], np.uint32)
        self.begin = np.array([0, 1], np.int64)

    def _ids(self, part: bytes) -> list[int]:
        text = part.decode()
        if _PLAIN.fullmatch(text):  # what stands before the model changes nothing else here
            return [token.id for token in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, part)))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        ids = [self._ids(part) for part in self.known.new]
        self.known.new.clear()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate([self.begin, np.cumsum(sizes) + len(self.flat)])
        more = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, more])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end token, and where each text begins."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        number: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            raw = text.encode()
            if b"<|" not in raw:  # special tokens are case-sensitive
                raw = _MARK.sub(rb" \1", raw.lower())
            number.extend(map(self.known.__getitem__, raw.split()))
            number.append(0)
            ends[i + 1] = len(number)
        self._learn()
        index = np.array(number, np.int64)
        begin, sizes = self.begin[index], self.begin[index + 1] - self.begin[index]
        upto = np.zeros(len(index) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)]
        return ids, upto[ends]


def _encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker: the files are read and words learned once."""
    return common.kept_in_worker(("encoder", path, end_id), lambda: Encoder(path, end_id))


def _batches(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in a row with about that many characters in each list."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text)
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows, then the rest of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, end_id)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [text or "" for text in batch.column(1).to_pylist()]
            rows = []
            done = 0
            for some in _batches(texts):
                tokens, begin = encode(some)
                tokens = tokens.astype("<u4")
                for k in range(len(some)):
                    n = int(begin[k + 1] - begin[k])
                    for start in range(0, n, capacity):
                        part = tokens[begin[k] + start : begin[k] + min(start + capacity, n)]
                        rows.append((ids[done + k], start, len(part), zlib.crc32(part.tobytes()), n))
                done += len(some)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each for one window: the longest, and what fills it best.

    ``sums[i]`` has bit s set if the lengths taken up so far can add up to s.
    """
    order = sorted(counts, reverse=True)
    longest = order[0]
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    used: list[tuple[int, int, int]] = []  # length, times, sums before it
    sums = 1
    for length in order:
        left = counts[length] - (length == longest)
        if length > room or left <= 0:
            continue
        most = min(left, room // length)
        times = 1
        while most > 0:  # 1, 2, 4, ... copies at once reach every count up to the most
            take = min(times, most)
            used.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            most -= take
            times *= 2
        if sums >> room & 1:
            break
    goal = sums.bit_length() - 1
    taken = {longest: 1}
    for length, take, before in reversed(used):
        if not before >> goal & 1:  # not reached without these copies
            goal -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, last number, first sequence, per sequence, offset) for all pieces.

    Piece k of a length (from 0), within first and last number, is in sequence
    ``first sequence + (k - first) // per``, at ``offset + (k - first) % per * length``.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    at = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        taken = fill(left, capacity)
        times = min(left[length] // n for length, n in taken.items())
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            out.append((length, at[length], at[length] + n * times - 1, sequence, n, offset))
            at[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return out


_PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "low", "high", "sequence", "per", "at")])


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    cut = common.durable(pieces(docs, tokenizer, capacity, end_id))
    # The written files give every row a fixed place: its input partition and number there.
    placed = cut.withColumn("place", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("place", 33)
    )
    per_part = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    # Lengths are at most the capacity, so this has no more rows than a window has tokens.
    totals = {row.length: row.n for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    in_part = Window.partitionBy("part", "length").orderBy("place")
    numbered = (
        placed.withColumn("nth", F.row_number().over(in_part) - 1)
        .join(offsets, ["length", "part"])
        .withColumn("number", F.col("ahead") + F.col("nth"))
        .drop("nth", "ahead", "place", "part")
    )
    return _assigned(numbered, plan(totals, capacity))


def _assigned(numbered: DataFrame, entries: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Look up each numbered piece in the plan, whose size the capacity bounds."""
    low: dict[int, np.ndarray] = {}
    rows: dict[int, np.ndarray] = {}
    for length in {e[0] for e in entries}:
        own = np.array(sorted(e[1:] for e in entries if e[0] == length), np.int64)
        low[length], rows[length] = own[:, 0], own
    shared = numbered.sparkSession.sparkContext.broadcast((low, rows))

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, rows = shared.value
        for frame in frames:
            sequence = np.zeros(len(frame), np.int64)
            offset = np.zeros(len(frame), np.int64)
            lengths, number = frame["length"].to_numpy(), frame["number"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for index in np.split(order, cuts):
                if len(index):
                    length = int(lengths[index[0]])
                    k = number[index]
                    own = rows[length][np.searchsorted(low[length], k, "right") - 1]
                    sequence[index] = own[:, 2] + (k - own[:, 0]) // own[:, 3]
                    offset[index] = own[:, 4] + (k - own[:, 0]) % own[:, 3] * length
            yield frame.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    return numbered.select(*columns, "number").mapInPandas(look_up, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
