"""Byte-level BPE against the tiktoken library, and its tables against plain dictionaries."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hopmetrics.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t",
    "It's the dog's; THEY'LL 've 12345 x²½ don’t",
    "<|endoftext|> is ordinary text here",
    "naïve éclair 東京 😀 👩‍👩‍👧 ​  \x1c\x1d\x85",
    "՘a֋ 1\U00011de0 2",  # letters and numbers of the newest Unicode only
    "x" * 30_000,
    " " * 20_001 + "a",
    "ab" * 20_000,
    "zqxjkvwq" * 500 + " word" * 3000,
    "same text",
    "same text",
]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.from_file(PATH)


@pytest.fixture(scope="module")
def split():
    return byte_bpe.Splitter(PATTERN, byte_bpe.unknown_characters())


def test_every_token_has_a_slot_of_its_own(vocabulary, ranks):
    slots = vocabulary.find(list(ranks))
    assert sorted(slots.tolist()) == list(range(len(ranks)))
    assert vocabulary.look_up(list(ranks)) == [[rank] for rank in ranks.values()]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 4097])
def test_perfect_hash_of_any_size(n):
    keys = [f"key {i * i}".encode() for i in range(n)]
    assert sorted(byte_bpe.PerfectHash(keys)(keys).tolist()) == list(range(n))


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="same"):
        byte_bpe.PerfectHash([b"a", b"b", b"a"])


def merged_plainly(piece, ranks):
    """Merges the first pair of lowest rank until there is none."""
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde nth'é東", min_size=1, max_size=40))
def test_merges_match_plain_ones(vocabulary, ranks, text):
    assert vocabulary.merged(text.encode()) == merged_plainly(text.encode(), ranks)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_texts_match_the_library(vocabulary, split, library, text):
    ids, begin = byte_bpe.Encoder(vocabulary, split)([text])
    assert ids.tolist() == library.encode_ordinary(text) and begin.tolist() == [0, len(ids)]
    raw, sizes = vocabulary.bytes_of(ids.astype("int64"))
    assert raw.tobytes() == text.encode() and sizes.sum() == len(raw)


def test_every_character_is_in_the_librarys_class(vocabulary, split, library):
    # Each between a letter, a number and a space, so that its class shows in the cuts.
    for low in range(0, 0x110000, 0x11000):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(low, low + 0x11000, 7) if not 0xD800 <= c < 0xE000)
        ids, _ = byte_bpe.Encoder(vocabulary, split)([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_a_full_memory_starts_anew(vocabulary, split, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 10)
    encoder = byte_bpe.Encoder(vocabulary, split)
    for text in ["one two three four five", "two zwei deux dos", "one two"]:
        assert encoder([text])[0].tolist() == library.encode_ordinary(text)


def test_rows_of_any_kind(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHARACTERS", 1000)
    rows = [(None if i == 4 else i // 2, text, "x", i) for i, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    encoded = byte_bpe.encode(docs, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    expected = sorted((str(r[0]), library.encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == expected
    back = byte_bpe.decode(encoded.withColumn("more", encoded["doc_id"]), PATH)
    assert back.columns == ["doc_id", "more", "decoded"]
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect()) == sorted(
        (str(r[0]), (r[1] or "").encode()) for r in rows
    )


def test_decoding_nulls_and_foreign_ids(spark):
    rows = spark.createDataFrame([(1, [31373]), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, PATH).collect()} == {1: b"hello", 2: b"", 3: b""}
    foreign = spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(foreign, PATH).collect()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    encoded = byte_bpe.encode(docs, PATH, PATTERN)
    assert encoded.collect() == [] and byte_bpe.decode(encoded, PATH).collect() == []


def test_query_gives_the_librarys_digests(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = byte_bpe.query(spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
