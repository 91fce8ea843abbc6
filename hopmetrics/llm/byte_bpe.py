"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. Tier one: the distinct
pre-tokens of a batch are hashed together, and a minimal perfect hash of the vocabulary
(as many slots as tokens, a displacement for each bucket of keys) gives each the one slot
it can have; equal bytes there settle its id. Tier two: a pre-token out of the vocabulary
is a linked list of bytes, whose neighbours wait in a heap by the rank of the token they
make; the lowest rank, the leftmost of equal ones, is merged first. A pre-token of n bytes
takes at most n - 1 merges and a heap of 3n entries, however long it is.

Both tables follow from the vocabulary alone. The driver builds them once and broadcasts
them: a few entries per token of the file. Texts stay in their partitions: no shuffle.

The pattern's letters, numbers and white space are those that the tiktoken library knows:
characters that only the newer Unicode of the regular expressions used here has among
them count as signs.

Cases: a null text is empty, and an empty text has no ids and decodes to no bytes. Texts of
any length are read whole. Null ids, repeated rows and shared ids give a row each, as they
came. Ids out of the vocabulary decode to an error, a null list of ids to no bytes. An empty
table gives an empty result. Other columns are ignored by ``encode`` and kept by ``decode``.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common

#: Characters of text that a task works on at once, and ids that it decodes at once.
CHARACTERS = 1_000_000
IDS = 1_000_000
#: Characters of distinct pre-tokens that a task keeps with their ids; beyond, it starts anew.
KNOWN = 4_000_000
#: Keys per bucket of the perfect hash, on average.
BUCKET = 2

_PRIME = np.uint64(0x100000001B3)
_START = np.uint64(0xCBF29CE484222325)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(keys: list[bytes]) -> np.ndarray:
    """A 64-bit hash per byte string: all keys take their next byte together."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    data = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    h = np.full(len(keys), _START, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    longest = -sizes[order]
    for at in range(int(sizes.max(initial=0))):
        some = order[: np.searchsorted(longest, -at, "left")]  # those longer than ``at``
        h[some] = (h[some] ^ data[begin[some] + at]) * _PRIME
    return _mix(h ^ sizes.astype(np.uint64))


class PerfectHash:
    """A slot for each of n distinct keys, from 0 to n - 1, by one displacement per bucket."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = max(1, len(keys))
        h = hashes(keys)
        if len(np.unique(h)) < len(keys):
            raise ValueError("two tokens of the vocabulary are the same or have one hash")
        self.shift = np.zeros(max(1, len(keys) // BUCKET), np.int64)
        taken = np.zeros(self.n, bool)
        buckets = (h % np.uint64(len(self.shift))).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1) if len(keys) else []
        groups.sort(key=len, reverse=True)
        alone = next((i for i, g in enumerate(groups) if len(g) == 1), len(groups))
        for group in groups[:alone]:
            for low in itertools.count(1, 32):
                tries = np.arange(low, low + 32)
                slots = self._slots(h[group][None], tries[:, None])
                free = ~taken[slots].any(axis=1)
                ordered = np.sort(slots, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if free.any():
                    first = int(free.argmax())
                    taken[slots[first]] = True
                    self.shift[buckets[group[0]]] = tries[first]
                    break
        # A key alone in its bucket takes any slot left, written down as a negative number.
        left = np.flatnonzero(~taken)
        for group, slot in zip(groups[alone:], left, strict=False):
            self.shift[buckets[group[0]]] = -1 - slot

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = _mix(h ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return (mixed % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """The only slot that each key can have; a key that is none of the n gets some slot too."""
        h = hashes(keys)
        shift = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0)))


class Vocabulary:
    """The tables of a vocabulary: tier one, tier two, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for bytes {missing}")
        tokens = list(ranks)
        self.longest = max(map(len, tokens))
        self.find = PerfectHash(tokens)
        slots = self.find(tokens)
        self.keys: list[bytes] = [b""] * len(tokens)
        self.ids = np.zeros(len(tokens), np.int64)
        for token, slot in zip(tokens, slots.tolist(), strict=True):
            self.keys[slot] = token
            self.ids[slot] = ranks[token]
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: Of two neighbouring tokens (left * base + right) the token that they make.
        self.base = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.base + right] = rank
        sizes = np.full(self.base, -1, np.int64)  # ids without a token stay at -1
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.sizes = sizes
        self.begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        by_id = sorted(ranks.items(), key=lambda item: item[1])
        self.flat = np.frombuffer(b"".join(token for token, _ in by_id), np.uint8)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """From lines of a token in base 64 and its rank."""
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in lines})

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merges, the lowest rank first."""
        n, base, pair = len(piece), self.base, self.pairs.get
        ids = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # What each token and its next one make, or None; the heap holds these by rank, then place.
        made = [pair(left * base + right) for left, right in zip(ids, ids[1:], strict=False)]
        made.append(None)
        heap = [rank * n + at for at, rank in enumerate(made) if rank is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            at = top % n
            rank = top // n
            if made[at] != rank:
                continue  # one of the two has been merged since
            right = after[at]
            ids[at], ids[right], made[right] = rank, -1, None
            after[at] = follows = after[right]
            if follows < n:
                before[follows] = at
                made[at] = new = pair(rank * base + ids[follows])
                if new is not None:
                    heapq.heappush(heap, new * n + at)
            else:
                made[at] = None
            ahead = before[at]
            if ahead >= 0:
                made[ahead] = new = pair(ids[ahead] * base + rank)
                if new is not None:
                    heapq.heappush(heap, new * n + ahead)
        return [i for i in ids if i >= 0]

    def look_up(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: whole if the vocabulary has it, else merged."""
        short = [i for i, piece in enumerate(pieces) if len(piece) <= self.longest]
        out: list[list[int] | None] = [None] * len(pieces)
        for i, slot in zip(short, self.find([pieces[i] for i in short]).tolist(), strict=True):
            if self.keys[slot] == pieces[i]:
                out[i] = [int(self.ids[slot])]
        return [self.merged(piece) if ids is None else ids for piece, ids in zip(pieces, out, strict=True)]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and how many each has."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.base and (self.sizes[ids] >= 0).all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(ids) else 0
        return self.flat[np.arange(total) + np.repeat(self.begin[ids] - (upto - sizes), sizes)], sizes


def _ranges(codes: list[int]) -> str:
    """A set of code points as a class of a regular expression."""
    out = []
    for _, run in itertools.groupby(enumerate(codes), lambda pair: pair[1] - pair[0]):
        run = [code for _, code in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return f"[{''.join(out)}]"


def unknown_characters() -> str:
    """A class of the characters that are letters, numbers or white space here and not for tiktoken.

    Empty if both have the same Unicode. For the pattern such a character is one of the rest.
    """
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    rest: set[str] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        # A pattern of one class: what it does not match has no ids.
        own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        known = set(bytes(own.encode_ordinary(every)).decode())
        found = set(regex.findall(name, every))
        if known - found:
            raise ValueError(f"{name} lacks characters that tiktoken has in it")
        rest |= found - known
    return _ranges(sorted(map(ord, rest))) if rest else ""


class Splitter:
    """Cuts texts into pre-tokens; ``unknown`` is a class of characters to take as signs."""

    def __init__(self, pattern: str, unknown: str) -> None:
        self.pattern = regex.compile(pattern)
        self.unknown = regex.compile(unknown) if unknown else None

    def __call__(self, text: str) -> list[str]:
        if self.unknown is None or text.isascii() or not self.unknown.search(text):
            return self.pattern.findall(text)
        masked = self.unknown.sub("\x01", text)  # a sign, as long as the character
        return [text[m.start() : m.end()] for m in self.pattern.finditer(masked)]


class _Numbers(dict):
    """Number of each pre-token, given when it is first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Ids of texts; the pre-tokens of one task are looked up once, until there are too many."""

    def __init__(self, vocabulary: Vocabulary, split: Splitter) -> None:
        self.vocabulary, self.split = vocabulary, split
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.held = 0
        # Ids of pre-token k are flat[begin[k] : begin[k + 1]].
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def _learn(self) -> None:
        ids = self.vocabulary.look_up([piece.encode() for piece in self.known.new])
        self.held += sum(map(len, self.known.new))
        self.known.new.clear()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        more = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
        self.begin = np.concatenate([self.begin, np.cumsum(sizes) + len(self.flat)])
        self.flat = np.concatenate([self.flat, more])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more for the end)."""
        if self.held > KNOWN:
            self._forget()
        index: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            index.extend(map(self.known.__getitem__, self.split(text)))
            ends[i + 1] = len(index)
        self._learn()
        at = np.array(index, np.int64)
        begin, sizes = self.begin[at], self.begin[at + 1] - self.begin[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        return self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)], upto[ends]


def _some(sizes: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` in each, one row at least."""
    at, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at <= i:
        yield at, i + 1


def _shared(spark: SparkSession, path: str) -> object:
    """The vocabulary's tables on all executors: a few entries for each token of the file."""
    return spark.sparkContext.broadcast(Vocabulary.from_file(path))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): a row per row of ``docs``."""
    shared = _shared(docs.sparkSession, vocabulary)
    unknown = unknown_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Encoder(shared.value, Splitter(pattern, unknown))
        for batch in batches:
            sizes = (len(text) for text in batch.column(1).cast(pa.large_binary()).to_pylist())
            for low, high in list(_some(sizes, CHARACTERS)):
                part = batch.slice(low, high - low)
                ids, begin = ids_of(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column(0), lists], names=["doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of its ids in the column ``into`` instead of the ids."""
    shared = _shared(rows.sparkSession, vocabulary)
    kept = [c for c in rows.columns if c not in (ids, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            counts = (n or 0 for n in lists.value_lengths().to_pylist())
            for low, high in list(_some(counts, IDS)):
                part = lists.slice(low, high - low)
                each = np.array([n or 0 for n in part.value_lengths().to_pylist()], np.int64)
                raw, sizes = tables.bytes_of(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                upto = np.concatenate([[0], np.cumsum(sizes)])
                ends = upto[np.concatenate([[0], np.cumsum(each)])].astype(np.int32)
                out = pa.Array.from_buffers(
                    pa.binary(), high - low, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]
                )
                others = [batch.column(i).slice(low, high - low) for i in range(batch.num_columns - 1)]
                yield pa.record_batch([*others, out], names=[*kept, into])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    return rows.select(*kept, F.col(ids).cast("array<int>")).mapInArrow(run, ", ".join([*fields, f"`{into}` binary"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    digests = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(digests, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
