"""Benchmark decontamination with spaced seeds.

A mask fixes which positions of a token window count. The counted tokens of each window
are hashed, for every mask, in the benchmark and in the documents; equal hashes are hits.
A substituted token that falls on an ignored position leaves the hit alive. Hits are put
together by document, item and diagonal (distance of the two positions), and around them
the item is laid over the document and compared token by token. Built-in functions only.

An overlap is reported if within the item some stretch of ``STRETCH`` tokens (the whole
item, if it is shorter) has at least ``AGREE`` of its tokens equal. Items of fewer than
``WHOLE`` tokens have to stand in the document whole, token by token.

Completeness. Wherever the substituted tokens of such a stretch lie, one of the masks has a
window within the stretch that avoids them all: ``LONG_MASKS`` in stretches of ``STRETCH``
tokens, ``SHORT_MASKS`` in those of ``WHOLE`` to ``STRETCH - 1`` (by enumeration of all
patterns, which a test repeats). So no overlap is without a hit. Items under ``WHOLE`` tokens
are hashed as a whole, by a mask of their own size. The short and whole masks are laid over
the documents only if the benchmark has items of these sizes.

Cases: null or empty texts and texts without tokens match nothing. Repeated items give a row
each; rows with the same ``doc_id`` are compared each on its own and reported by their
id. Empty tables give an empty result. Other columns, whatever their names, are ignored by
``overlaps`` and passed on by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common, licenses

#: Positions of 1 count, of 0 are ignored. For items of at least ``STRETCH`` tokens:
LONG_MASKS = ("111011", "1100001011", "110111")
#: For shorter items:
SHORT_MASKS = ("1111", "11011", "1100011")
STRETCH = 13
AGREE = 0.75
#: Items with fewer tokens than this are met as a whole only.
WHOLE = 8
#: Masks, with the least and the most tokens of the items that they are for.
MASKS = (
    *((mask, STRETCH, 2**31 - 1) for mask in LONG_MASKS),
    *((mask, WHOLE, STRETCH - 1) for mask in SHORT_MASKS),
    *(("1" * n, n, n) for n in range(1, WHOLE)),
)


def tokens(text: Column) -> Column:
    """Words of letters, digits and all that is not ASCII, A-Z in lower case."""
    return F.array_remove(F.split(licenses.words_of(text), " +"), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, mask: str) -> Column:
    """Hash of the counted tokens at each start; null if the text is shorter than the mask."""
    counted = [i for i, c in enumerate(mask) if c == "1"]
    starts = F.sequence(F.lit(0), F.size(hashes) - len(mask))
    seed = F.transform(starts, lambda s: F.xxhash64(*(F.get(hashes, s + i) for i in counted)))
    return F.when(F.size(hashes) >= len(mask), seed)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), _hashes(common.text_or_empty()).alias("item")
    ).filter(F.size("item") > 0)


def _needed(length: Column) -> Column:
    """How many tokens of a stretch have to be equal."""
    return F.when(length < WHOLE, length).otherwise(F.ceil(length * AGREE))


def test_seeds(benchmark: DataFrame) -> DataFrame:
    """mask, seed, item_id, n_item, at: all windows of all items, by the masks for their size."""
    # Null for the masks that are not for the item's size.
    n = F.size("item")
    masks = F.array(*(F.when(n.between(least, most), _seeds(F.col("item"), mask)) for mask, least, most in MASKS))
    return (
        _items(benchmark)
        .select("item_id", F.size("item").alias("n_item"), F.posexplode(masks).alias("mask", "seeds"))
        .select("item_id", "n_item", "mask", F.posexplode("seeds").alias("at", "seed"))
    )


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc, body, item_id, n_item, diagonal: where a seed of the document is one of the item."""
    text = common.text_or_empty()
    hashed = docs.select(common.doc_key().alias("doc"), F.xxhash64(text).alias("body"), _hashes(text).alias("hashes"))
    n = F.size("item")
    wanted = _items(benchmark).agg(*(F.max(n.between(least, most)) for _, least, most in MASKS)).first()
    by_mask = [
        F.struct(F.lit(k).alias("mask"), _seeds(F.col("hashes"), mask).alias("seeds"))
        for k, (mask, _, _) in enumerate(MASKS)
        if wanted[k]
    ]
    if not by_mask:  # no item has a token
        by_mask = [F.lit(None).cast("struct<mask:int,seeds:array<bigint>>")]
    return (
        hashed.select("doc", "body", F.inline(F.array(*by_mask)))
        .select("doc", "body", "mask", F.posexplode("seeds").alias("pos", "seed"))
        .join(test_seeds(benchmark), ["seed", "mask"])
        .select("doc", "body", "item_id", "n_item", (F.col("pos") - F.col("at")).alias("diagonal"))
        .distinct()
    )


def _best_stretch(equal: Column, length: Column) -> Column:
    """Most equal tokens in any stretch of the length."""
    starts = F.sequence(F.lit(1), F.size(equal) - length + 1)
    sums = F.transform(
        starts, lambda s: F.aggregate(F.slice(equal, s, length), F.lit(0), lambda a, x: a + x)
    )
    return F.when(F.size(equal) >= length, F.array_max(sums)).otherwise(0)


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    text = common.text_or_empty()
    texts = docs.select(common.doc_key().alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    # All hits of a document: of its own windows, times the items that have their seeds.
    per_doc = (
        hits(docs, benchmark)
        .groupBy("doc", "body")
        .agg(F.collect_list(F.struct("item_id", "n_item", "diagonal")).alias("hits"))
    )

    def laid(hashes: Column):
        def under(h: Column) -> Column:
            start = F.greatest(h["diagonal"], F.lit(0))
            return F.struct(
                h["item_id"].alias("item_id"),
                h["diagonal"].alias("diagonal"),
                F.slice(hashes, start + 1, h["n_item"]).alias("part"),
            )

        return under

    pairs = (
        texts.join(per_doc, ["doc", "body"])
        .select("doc", "body", "hits", _hashes(F.col("text")).alias("hashes"))
        .select("doc", "body", F.inline(F.transform("hits", laid(F.col("hashes")))))
        .dropDuplicates(["doc", "body", "item_id", "diagonal"])
    )
    of_item = F.slice("item", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("item"))
    common_size = F.least(F.size("part"), F.size("of_item"))
    equal = F.zip_with(
        F.slice("part", F.lit(1), common_size), F.slice("of_item", F.lit(1), common_size), lambda a, b: (a == b).cast("int")
    )
    length = F.least(F.size("item"), F.lit(STRETCH))
    compared = (
        pairs.join(_items(benchmark), "item_id")
        .withColumn("of_item", of_item)
        .withColumn("equal", equal)
        .filter(_best_stretch(F.col("equal"), length) >= _needed(length))
    )
    n_equal = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    best = F.max(
        F.struct(
            n_equal.cast("long").alias("n_equal"),
            (-F.greatest("diagonal", F.lit(0))).cast("long").alias("at"),
            F.size("equal").cast("long").alias("n_words"),
        )
    ).alias("best")
    return compared.groupBy("doc", "body", "item_id").agg(best)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: the best overlap of each pair.

    ``first_word`` is where the overlap begins in the document (words from 0), ``n_words``
    how many words of the item lie over it, ``n_equal`` how many of them are equal.
    """
    return _overlaps(docs, benchmark).select(
        F.when(F.col("doc") != common.NO_ID, F.col("doc")).alias("doc_id"),
        "item_id",
        (-F.col("best.at")).alias("first_word"),
        F.col("best.n_words").alias("n_words"),
        F.col("best.n_equal").alias("n_equal"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with their columns, whose text overlaps no item."""
    marked = docs.select(
        F.struct("*").alias("row"), common.doc_key().alias("doc"), F.xxhash64(common.text_or_empty()).alias("body")
    )
    bad = _overlaps(docs, benchmark).select("doc", "body").distinct()
    return marked.join(bad, ["doc", "body"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _sql_key(mask: str) -> str:
    return " || ' ' || ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1")


def _sql_seeds(source: str, id_name: str) -> str:
    """Of the items, the masks for their size; of the documents, those that some item needs."""
    needed = "{}" if source == "b" else "EXISTS (SELECT 1 FROM b WHERE {})"
    return " UNION ALL ".join(
        f"""SELECT {id_name}, {m} AS mask, i - 1 AS pos, {_sql_key(mask)} AS seed
            FROM (SELECT {id_name}, w, unnest(range(1, len(w) - {len(mask)} + 2)) AS i FROM {source}
                  WHERE {needed.format(f"len(b.w) BETWEEN {least} AND {most}")})"""
        for m, (mask, least, most) in enumerate(MASKS)
    )


def _sql_needed(length: str) -> str:
    return f"CASE WHEN {length} < {WHOLE} THEN {length} ELSE ceil({length} * {AGREE}) END"


#: Seeds are the counted words themselves; each diagonal met is compared word by word.
ORACLE = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
    SELECT * FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0
), ds AS ({_sql_seeds("d", "doc_id")}), bs AS ({_sql_seeds("b", "item_id")}
), diagonals AS (
    SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS diagonal FROM ds JOIN bs USING (mask, seed)
), laid AS (
    SELECT doc_id, item_id, diagonal, greatest(diagonal, 0) AS first_word, least(len(b.w), {STRETCH}) AS length,
           list_transform(range(greatest(0, -diagonal), least(len(b.w), len(d.w) - diagonal)),
                          lambda k: (d.w[k + diagonal + 1] = b.w[k + 1])::BIGINT) AS equal
    FROM diagonals JOIN d USING (doc_id) JOIN b USING (item_id)
), judged AS (
    SELECT doc_id, item_id, first_word, len(equal) AS n_words, list_sum(equal) AS n_equal,
           list_max(list_transform(range(1, len(equal) - length + 2),
                                   lambda s: list_sum(equal[s:s + length - 1]))) AS best, length
    FROM laid WHERE len(equal) >= length
)
SELECT doc_id, item_id, arg_max(first_word, (n_equal, -first_word, n_words))::BIGINT AS first_word,
       arg_max(n_words, (n_equal, -first_word, n_words))::BIGINT AS n_words, max(n_equal)::BIGINT AS n_equal
FROM judged WHERE best >= {_sql_needed("length")} GROUP BY doc_id, item_id
"""
