"""How many shuffles the near-duplicate search takes, and its components against a search by hand."""

from __future__ import annotations

import numpy as np
import pytest

from hopmetrics.llm import common, minhash


@pytest.fixture
def written(spark, monkeypatch):
    """Shuffles by hash in the plan of each table written, if all tables are too large to be broadcast."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    shuffles, durable = [], common.durable

    def counting(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return durable(df)

    monkeypatch.setattr(common, "durable", counting)
    yield shuffles
    spark.conf.set(threshold, before)


def labels_by_hand(edges):
    label = {n: n for e in edges for n in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def graphs():
    rng = np.random.default_rng(3)
    yield "chain", [(i, i + 1) for i in rng.permutation(40).tolist()]
    yield "largest in the middle", [(100, i) for i in range(20)] + [(100, 3), (3, 100)]
    yield "two parents each", [(i, j) for i in range(30, 60) for j in (i % 7, 10 + i % 5)] * 2
    yield "loops only", [(5, 5)]
    for n in (15, 40, 80):
        yield f"random, {n}", [tuple(e) for e in rng.integers(0, 60, (n, 2)).tolist()]


@pytest.mark.parametrize(("name", "edges"), graphs(), ids=lambda x: x if isinstance(x, str) else "")
def test_connected_as_by_hand(spark, name, edges):
    got = minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    wanted = labels_by_hand([e for e in edges if e[0] != e[1]])
    assert sorted((r.node, r.label) for r in got) == sorted(wanted.items())


def test_a_star_takes_one_round(spark, written):
    got = minhash.connected(spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long"))
    assert {(r.node, r.label) for r in got.collect()} == {(i, 0) for i in range(30)}
    assert sum(written) <= 8


def test_shuffles_of_all_steps(spark, written, monkeypatch):
    """Templates whose fillings are too different to link, with copies in them, so that lists are left over after the hubs."""
    monkeypatch.setattr(minhash, "DENSE", 0.5)
    forests, dense_links = [], minhash._dense_links

    def counting(members, *rest):
        forests.append(members.count())
        return dense_links(members, *rest)

    monkeypatch.setattr(minhash, "_dense_links", counting)
    rng = np.random.default_rng(7)
    rows = []
    for template in range(2):
        frame = [f"t{template}w{i}" for i in range(150)]
        for copy in range(10):
            words = list(frame)
            for place in rng.choice(range(10, 140), 2, replace=False):
                words[place] = f"own{rng.integers(0, 10**9)}"
            rows += [" ".join(words), " ".join([*words, "tail"])][: 1 + copy % 2]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc: r.component for r in minhash.components(table).collect()}
    sets = [{tuple(r.split()[i : i + 5]) for i in range(len(r.split()) - 4)} for r in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a, len(rows)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    assert got == labels_by_hand(links)
    assert forests and forests[0]
    assert sum(written) <= 70
