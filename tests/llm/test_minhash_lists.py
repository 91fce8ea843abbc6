"""Comparing the lists that hubs leave over, against all pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from hopmetrics.llm import minhash

K, PERCENT = 16, 80


def some_lists(seed, members):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    rows, sets = [], {}
    for node in range(members):
        own = set(rng.choice(base[:40], rng.integers(1, 30), replace=False).tolist())
        if node % 2:  # like the one before, but for a few
            own = set(sorted(sets[node - 1])[rng.integers(0, 3) :]) | set(rng.integers(0, 2**63, 2, dtype=np.uint64).tolist())
        sets[node] = own
    for value in range(6):
        for node in rng.choice(members, rng.integers(2, members), replace=False):
            n = len(sets[node])
            sketch = np.sort(np.array(list(sets[node]), np.uint64))[:K]
            marked = np.zeros(minhash.BITS, bool)
            marked[sketch % np.uint64(minhash.BITS)] = True
            rows.append((value, 0, 0, 0, int(node), n, int(node) // 4, np.packbits(marked).tobytes()))
    frame = pd.DataFrame(rows, columns=["value", "i", "j", "at", "node", "n", "label", "bits"])
    return frame, {node: set(np.sort(np.array(list(s), np.uint64))[:K].tolist()) for node, s in sets.items()}


@pytest.mark.parametrize("dense", [0, 0.5, 4])
@pytest.mark.parametrize("seed", range(5))
def test_no_pair_of_a_list_is_lost(monkeypatch, dense, seed):
    monkeypatch.setattr(minhash, "DENSE", dense)
    frame, sketches = some_lists(seed, 24)
    found = minhash._candidates(frame, K, PERCENT)
    pairs = {(a, b) for a, b in found[found["list"].isna()][["a", "b"]].itertuples(index=False)}
    lists = [set(g["a"]) for _, g in found[found["list"].notna()].groupby("list")]
    assert all(len(g) > 1 for g in lists)
    if dense == 0:
        assert not pairs and lists
    wanted = 0
    for _, members in frame.groupby("value"):
        own = members.set_index("node")
        for a, b in combinations(sorted(own.index), 2):
            if own.label[a] == own.label[b] or min(own.n[a], own.n[b]) * 100 < max(own.n[a], own.n[b]) * PERCENT:
                assert (a, b) not in pairs
                continue
            least = min(minhash.least_shared(len(sketches[node]), K, PERCENT) for node in (a, b))
            if len(sketches[a] & sketches[b]) >= least:
                wanted += 1
                assert (a, b) in pairs or any({a, b} <= g for g in lists)
    assert wanted


def test_pairs_within_runs():
    begin = np.array([0, 1, 4, 4, 9])
    for most in (1, 3, 100):
        got = [(int(a), int(b)) for x, y in minhash._pairs_within(begin, most) for a, b in zip(x, y, strict=True)]
        assert got == [p for lo, hi in zip(begin, begin[1:], strict=False) for p in combinations(range(lo, hi), 2)]
    assert list(minhash._pairs_within(np.zeros(1, int), 10)) == []


def test_lists_in_blocks(spark, monkeypatch):
    """Templates whose fillings are too different to link, in lists of several blocks, with a few copies in them."""
    rng = np.random.default_rng(7)
    rows = []
    for template in range(3):
        frame = [f"t{template}w{i}" for i in range(60)]
        for _ in range(30):
            words = list(frame)
            for place in rng.choice(60, 4, replace=False):
                words[place] = f"own{rng.integers(0, 10**9)}"
            rows.append(" ".join(words))
            if rng.random() < 0.3:
                rows.append(rows[-1] + " tail")
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [{tuple(r.split()[i : i + 5]) for i in range(len(r.split()) - 4)} for r in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    for block in (3, 1000):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc: r.component for r in minhash.components(table).collect()}
        assert got == dict(enumerate(label))
