"""Line dedup: lines that several documents hold stay in the smallest document only.

Lines are exploded, their normalised form (the key) is hashed to 128 bits, distinct
documents are counted per hash, and the lines of a hash at or over the threshold are
dropped from all documents but its smallest; the others are put together again by
position. Built-in functions only.

Cases: a null text is one empty line, like an empty text. A null ``doc_id`` counts as
one document after all others. Rows with the same ``doc_id`` are one document when
documents are counted, and each keeps its own lines. Lines with a key shorter than
``min_chars`` code points always stay; a document that loses all its lines gets an empty
text. An empty table gives an empty result. Other columns, whatever their names, are
passed on by ``dedup_lines`` and ignored by ``line_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case."""
    return common.lower_ascii(F.trim(line, F.lit(common.SPACE)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line that may be dropped: document, text, position and hash of the key."""
    text = common.text_or_empty()
    # The key's hash in two halves with different seeds: 64 bits alone collide at 1e11 lines.
    return (
        docs.select(
            common.doc_key().alias("doc"),
            F.xxhash64(text).alias("body"),
            F.posexplode(F.split(text, "\n")).alias("pos", "line"),
        )
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hash, number of distinct documents and smallest document of each key to drop."""
    # Distinct first, so that a line in a third of all documents is counted by all tasks.
    return (
        _lines(docs, min_chars)
        .select("h1", "h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.min("doc").alias("holder"))
        .filter(F.col("n_docs") >= min_docs)
    )


def _with_kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept`` (the new text)."""
    # Written down, both sides of the join come from plain exchanges, and a line in a third
    # of all documents is split over tasks when it is joined.
    repeated = common.durable(repeated_keys(docs, min_chars, min_docs))
    drops = (
        _lines(docs, min_chars)
        .join(repeated, ["h1", "h2"])
        .filter(F.col("doc") != F.col("holder"))
        .groupBy("doc", "body")
        .agg(F.collect_set("pos").alias("drop"))
    )
    text = common.text_or_empty()
    rows = docs.select(
        F.struct("*").alias("row"), common.doc_key().alias("doc"), F.xxhash64(text).alias("body"), text.alias("whole")
    )
    split = rows.join(drops, ["doc", "body"], "left").select(
        "row", "whole", "drop", F.split("whole", "\n").alias("lines")
    )
    positions = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(positions, F.col("drop")), lambda p: F.get("lines", p))
    return split.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the new text of each row."""
    return _with_kept(docs, min_chars, min_docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("text")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows with their columns, ``text`` without the dropped lines.

    A text that loses nothing stays as it is, null included; ``n_chars``, where there is
    one, becomes the length of a changed text.
    """
    done = _with_kept(docs, min_chars, min_docs)
    changed = F.col("n_dropped") > 0

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.when(changed, F.col("kept")).otherwise(old).alias(name)
        if name == "n_chars":
            return F.when(changed, F.char_length("kept").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return done.select(*(column(name) for name in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_report(common.table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
    SELECT key, min(doc_id) AS holder FROM lines WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.holder AS gone
    FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
