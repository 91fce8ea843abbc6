"""Cases in which an operator or a stage once did less than its whole job."""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pytest

import corpus_pipeline
from hopmetrics.llm import decontamination, minhash

SCHEMA = "doc_id long, text string, lang string"


def words(name: str, n: int = 240, changed: int = 0) -> str:
    """``n`` words, of which some, far from each other, are replaced."""
    some = [f"{name}{k}" for k in range(n)]
    for k in range(changed):
        some[10 + 20 * k] = f"{name}other{k}"
    return " ".join(some)


def test_near_dedup_stage_takes_copies_from_80_per_cent(spark):
    # Of 236 shingles each replaced word takes 5: similarity 0.84, 0.81 and 0.77.
    rows = [
        (1, words("a"), "en"),
        (2, words("a", changed=4), "en"),
        (3, words("b"), "en"),
        (4, words("b", changed=5), "en"),
        (5, words("c"), "en"),
        (6, words("c", changed=6), "en"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]


def test_minhash_dedup_judges_rows_and_not_ids(spark):
    rows = [
        (1, words("a"), "1"),
        (None, words("a", changed=2), "near copy of 1"),
        (None, words("b"), "unique, no id"),
        (None, "", "blank, no id"),
        (None, None, "null, no id"),
        (None, words("c"), "copies without id"),
        (None, words("c"), "copies without id"),
        (None, words("c", changed=1), "copies without id"),
        (7, words("d"), "shared id, unique"),
        (7, words("a", changed=1), "shared id, copied"),
        (8, words("e"), "repeated rows"),
        (8, words("e"), "repeated rows"),
        (9, words("e"), "copy of a repeated row"),
        (9, " ", "blank"),
        (9, " ", "blank"),
        (10, words("f"), "two like texts of one id"),
        (10, words("f", changed=1), "two like texts of one id"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.lang for r in kept.collect()) == sorted(
        [
            "1",
            "unique, no id",
            "blank, no id",
            "null, no id",
            "copies without id",
            "shared id, unique",
            "repeated rows",
            "blank",
            "blank",
            "two like texts of one id",
        ]
    )
    assert minhash.dedup(docs.filter("doc_id is null and text is null")).count() == 1


def accepted(doc: list[str], item: list[str]) -> tuple[int, int, int] | None:
    """first_word, n_words, n_equal of the best overlap, from every diagonal and without seeds."""
    length, best = min(len(item), 13), None
    needed = ceil(0.75 * length) if length >= 8 else length
    for diagonal in range(length - len(item), len(doc) - length + 1):
        equal = [doc[k + diagonal] == w for k, w in enumerate(item) if 0 <= k + diagonal < len(doc)]
        if any(sum(equal[s : s + length]) >= needed for s in range(len(equal) - length + 1)):
            found = (sum(equal), -max(diagonal, 0), len(equal))
            best = max(best or found, found)
    return best and (-best[1], best[2], best[0])


@pytest.mark.parametrize("n", range(8, 14))
def test_masks_meet_every_accepted_pattern(n):
    masks = decontamination.LONG_MASKS if n >= decontamination.STRETCH else decontamination.SHORT_MASKS
    for changed in combinations(range(n), n - ceil(0.75 * n)):
        assert any(
            all(m == "0" or s + k not in changed for k, m in enumerate(mask))
            for mask in masks
            for s in range(n - len(mask) + 1)
        ), changed


@pytest.mark.parametrize("sizes", [(8, 9, 10, 11, 12, 13), (13, 16, 25)])
def test_decontamination_equals_all_diagonals(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in sizes}
    docs: list[list[str]] = []
    for n, item in items.items():
        most = n - ceil(0.75 * n)
        ways = list(combinations(range(n), most)) if n <= 13 else [rng.choice(n, most, replace=False) for _ in range(200)]
        ways += [rng.choice(n, most + 1, replace=False) for _ in range(20)]
        for changed in ways:
            text = ["x" if k in changed else w for k, w in enumerate(item)]
            docs.append(["before"] * int(rng.integers(0, 3)) + text[int(rng.integers(0, 2)) * (n > 13) :] + ["after"])
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")
    want = {(i, n): a for i, d in enumerate(docs) for n, item in items.items() if (a := accepted(d, item))}
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontamination.overlaps(table, bench).collect()}
    assert len(want) > 200 and got == want


def test_short_items_are_found_whole(spark):
    """Items of 1 to 7 tokens, alone and beside longer ones, equal all diagonals."""
    rng = np.random.default_rng(3)
    letters = [f"t{k}" for k in range(4)]
    docs = [list(rng.choice(letters, rng.integers(0, 30))) for _ in range(80)]
    items = {n: list(rng.choice(letters, n)) for n in range(8)} | {8: ["t0"] * 8, 20: docs[5][:20] or ["t1"] * 20}
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    for some in (range(8), (3, 8, 20), (0,)):
        bench = spark.createDataFrame([(n, " ".join(items[n])) for n in some], "item_id long, text string")
        want = {(i, n): a for i, d in enumerate(docs) for n in some if items[n] and (a := accepted(d, items[n]))}
        got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontamination.overlaps(table, bench).collect()}
        assert got == want and (len(want) > 20 or some == (0,))
    found = {i for i, n in want}
    assert decontamination.clean(table, bench).count() == len(docs) - len(found)
