"""Exact products, vector codes and whitening against plain arithmetic."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from hopmetrics.llm import exact, spectrum, vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell int, n string, error string"
DOUBLES = SCHEMA.replace("array<float>", "array<double>")


def table(spark, rows, schema=SCHEMA):
    """Rows of (vec_id, embedding, label) with columns that clash with the operators' own."""
    return spark.createDataFrame([(*row, "x", 1, "y", "z") for row in rows], schema)


def odd_rows(d=8, n=60):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=d).astype("float32").tolist(), int(i % 3)) for i in rng.permutation(n)]
    rows += [
        (900, None, 1),
        (901, [], 1),
        (902, [1.0, None] + [0.0] * (d - 2), 1),
        (903, [math.nan] + [0.0] * (d - 1), 1),
        (904, [math.inf] + [0.0] * (d - 1), 2),
        (905, [0.0] * d, None),
        (906, rows[3][1], None),
        (None, rows[4][1], 0),
        (None, [-0.5] * d, None),
        rows[5],
        rows[5],
        (rows[6][0], [0.25] * d, 2),
    ]
    return rows


def sound(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.mark.parametrize("largest", [1, 1000, 2**24, 2**31, 2**45])
def test_products_are_exact(largest):
    rng = np.random.default_rng(largest % 97)
    a, b = rng.integers(-largest, largest + 1, (30, 17)), rng.integers(-largest, largest + 1, (17, 9))
    expected = a.astype(object).dot(b.astype(object)).ravel()
    assert all((int(x) - int(y)) % 2**64 == 0 for x, y in zip(exact.matmul(a, b).ravel(), expected, strict=True))
    assert (exact.gram(a) == a.astype(object).T.dot(a.astype(object))).all()


def test_limbs_add_up():
    x = np.array([[0, 1, -1, 2**40 + 7, -(2**40) - 7, 2**24, -(2**24)]])
    for bits in (2, 8, 25):
        parts = exact.limbs(x, bits)
        assert (sum(p.astype(np.int64) << (bits * i) for i, p in enumerate(parts)) == x).all()
        assert all(np.abs(p).max() <= 2 ** (bits - 1) for p in parts)


def test_halves_add_up():
    for v in (0, 1, -1, 2**70, -(2**70) - 3):
        (high,), (low,) = exact.halves([v])
        assert exact.whole(high, low) == v and 0 <= low < 2**32


def test_too_large_components_are_refused():
    with pytest.raises(ValueError, match="2\\^52"):
        exact.scaled(np.array([2.0**42]))
    assert exact.scaled(np.array([-0.0001, 0.0, 1.5])).tolist() == [-1, 0, 1536]


def coded_plainly(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks by Python integers."""
    x = [[math.floor(1024 * c) for c in r[1]] for r in rows]
    width = len(x[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    cut = [[row[p * width : (p + 1) * width] for p in range(parts)] for row in x]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def away(a, b):
        return sum((u - w) ** 2 for u, w in zip(a, b, strict=True))

    def assign():
        return [[min((away(row[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            groups = defaultdict(list)
            for row, near in zip(cut, found, strict=True):
                groups[near[p][1]].append(row[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = assign()
    flat = [c for book in books for entry in book for c in entry]
    return (
        ["".join(f"{k:02x}" for _, k in near) for near in found],
        [sum(d for d, _ in near) for near in found],
        hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest(),
    )


@pytest.mark.parametrize("scale", [1.0, 3e6, 1e9])
def test_codes_match_plain_integers(spark, tmp_path, scale):
    rows = [(i, v and [c if c is None else float(c) * scale for c in v], label) for i, v, label in odd_rows()]
    path = f"{tmp_path}/embeddings.parquet"
    table(spark, rows, DOUBLES).repartition(5).write.parquet(path)
    kept = sound(rows)
    codes, errors, digest = coded_plainly(kept)
    labels = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] += e
    found = vector_codes.query(spark, str(tmp_path)).collect()
    expected = [
        (str(r[0]), c, *(v if v <= exact.LONG else None for v in (e, labels[r[2]])), digest)
        for r, c, e in zip(kept, codes, errors, strict=True)
    ]
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, found)) == sorted(expected)


def test_codebooks_of_more_rows_than_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("float32").tolist(), 0) for i in range(150)]
    rows += [(150 + i, rows[3][1], 0) for i in range(75)]  # a third of the rows are one vector
    kept = vector_codes.kept(table(spark, rows))
    books = vector_codes.codebooks(kept, 8, parts=2, entries=16, rounds=3)
    codes, errors, digest = coded_plainly(rows, 2, 16, 3)
    assert vector_codes.digest(books) == digest
    found = {r.vec_id: r for r in vector_codes.compress(kept, books).collect()}
    assert ["".join(f"{c:02x}" for c in found[r[0]].codes) for r in rows] == codes
    assert [found[r[0]].error for r in rows] == errors
    back = vector_codes.restore(np.array([found[r[0]].codes for r in rows]), books)
    x = exact.scaled(np.array([r[1] for r in rows]))
    assert ((back - x) ** 2).sum(axis=1).tolist() == errors


def test_first_of_equally_near_entries():
    entries = np.array([[4, 0], [0, 4], [0, 4], [4, 0]])
    code, away = vector_codes.nearest(np.array([[0, 4], [4, 0], [2, 2]]), entries)
    assert code.tolist() == [1, 0, 0] and away.tolist() == [0, 0, 8]
    wide, far = vector_codes.nearest(np.array([[0, 4], [4, 0], [2, 2]]) << 40, entries << 40)
    assert wide.tolist() == [1, 0, 0] and far.tolist() == [0, 0, 8 << 80]


def test_a_label_is_joined_in_salted_groups(spark):
    plan = vector_codes.with_label_error(
        spark.createDataFrame([(1, 1, [0], 5), (2, None, [0], 7)], "vec_id long, label int, codes array<int>, error long")
    )
    assert {(r.vec_id, r.label_error) for r in plan.collect()} == {(1, 5), (2, 7)}
    assert "salt" in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("module", [vector_codes, whitening])
def test_nothing_to_work_on(spark, tmp_path, module):
    rows = [] if module is vector_codes else [(1, None, 1), (2, [], 2)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert module.query(spark, str(tmp_path)).collect() == []


def test_vectors_of_different_lengths_are_refused(spark):
    rows = table(spark, [(1, [1.0, 2.0], 1), (2, [1.0], 1)])
    with pytest.raises(ValueError, match="from 1 to 2"):
        vectors.dimension(whitening.kept(rows), "v")
    with pytest.raises(ValueError, match="do not divide"):
        vector_codes.codebooks(whitening.kept(rows), 6)


def test_pivots_count_negative_eigenvalues():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 10, 31):
        a = rng.normal(size=(d, d))
        a += a.T
        for shift in rng.uniform(-6, 6, 40):
            assert spectrum.negatives(a - shift * np.eye(d)) == (np.linalg.eigvalsh(a) < shift).sum()
    assert spectrum.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1  # no pivot of one row
    assert spectrum.negatives(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("gap", [1e-2, 1e-7, 1e-13, 0.0])
def test_close_and_equal_eigenvalues(gap):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    values = np.concatenate([[7, 7 - gap, 7 - 2 * gap, 3, 3, 2], rng.uniform(0, 1, 18)])
    v = (q * values) @ q.T
    found, basis = spectrum.leading((v + v.T) / 2, 8)
    assert np.allclose(found, sorted(values)[::-1][:8], rtol=0, atol=1e-13)
    assert np.allclose(basis @ basis.T, np.eye(8), atol=1e-13)
    assert np.allclose(v @ basis.T, basis.T * found, atol=1e-13)


def whitened_plainly(rows, count=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in rows], object)
    n, total = len(x), x.sum(axis=0)
    away = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    centred = (x * n - total).astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return away, centred @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize(("d", "scale"), [(12, 1.0), (3, 1.0), (12, 2e9)])
def test_whitening_matches_a_full_decomposition(spark, tmp_path, d, scale):
    rows = [(i, v and [c if c is None else float(c) * scale for c in v], label) for i, v, label in odd_rows(d)]
    table(spark, rows, DOUBLES).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = sound(rows)
    away, w, explained = whitened_plainly(kept)
    found = whitening.query(spark, str(tmp_path)).collect()
    count = min(8, d)
    assert len(found) == len(kept) * count
    assert {r.n for r in found} == {len(kept)} and max(r.identity_error for r in found) < 1e-9
    for k in range(count):
        own = [r for r in found if r.component == k + 1]
        assert {r.explained for r in own} == {own[0].explained} and math.isclose(own[0].explained, explained[k], rel_tol=1e-9)
        key = [(str(r[0]), a if a <= exact.LONG else None) for r, a in zip(kept, away, strict=True)]
        assert sorted((str(r.vec_id), r.deviation or 0) for r in own) == sorted((i, a or 0) for i, a in key)
        # Either sign, the same for all rows; copies of an id are told apart by their values.
        signs = []
        for sign in (1, -1):
            expected = sorted((i, round(sign * value, 6) + 0.0) for (i, _), value in zip(key, w[:, k], strict=True))
            signs.append(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(
                sorted((str(r.vec_id), round(r.whitened, 6) + 0.0) for r in own), expected, strict=True)))
        assert any(signs)


def test_components_without_variance(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(5)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = whitening.query(spark, str(tmp_path)).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 12)) for r in found} == {
        (1, False, 1.0), (2, True, 0.0), (3, True, 0.0)
    }
    assert max(r.identity_error for r in found) < 1e-12
    model = whitening.fit(whitening.kept(table(spark, [(1, [3.0, 4.0], 0)])), 2)
    assert model.n == 1 and model.used == [False, False] and model.explained == [0.0, 0.0]


def test_covariance_does_not_depend_on_partitions(spark):
    rows = sound(odd_rows())
    once = [whitening.fit(whitening.kept(table(spark, rows).repartition(k)), 8) for k in (1, 7)]
    assert (once[0].values == once[1].values).all() and (once[0].components == once[1].components).all()
