"""Whitening against exact integers and a library eigenvalue solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from wavetrail.llm import whitening
from wavetrail.llm.common import reach_workers

SCHEMA = "vec_id long, embedding array<float>, label int, v string, component string, n string"


@pytest.fixture
def table(spark):
    reach_workers(spark)

    def make(rows, kind="float"):
        held = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "v", "c", "n") for i, v in rows]
        return spark.createDataFrame(held, SCHEMA.replace("array<float>", f"array<{kind}>")).repartition(3)

    return make


def brute(rows, wanted=32):
    """(id -> list of (deviation, centred)), sums and covariance by exact fractions."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[k] for _, v in x) for k in range(d)]
    centred = [[n * v[k] - s[k] for k in range(d)] for _, v in x]
    cov = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return n, [sum(a * a for a in c) for c in centred], np.array(centred, float) / n @ vectors / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("d", [2, 5, 40])
def test_whitening_equals_the_plain_computation(table, d):
    rng = np.random.default_rng(d)
    mix = rng.normal(0, 1, (d, d)) * np.linspace(0.2, 2, d)
    good = [(i, (rng.normal(0, 1, d) @ mix).astype(np.float32).tolist()) for i in range(150)]
    good += [(7, good[0][1]), (None, good[1][1]), (150, (-np.array(good[3][1])).tolist())]
    bad = [(900, None), (901, [None] * d), (902, [float("nan")] + [0.0] * (d - 1)), (903, [0.0] * (d - 1) + [float("inf")]), (904, [1.0] * (d + 1)), (905, [])]
    n, deviation, whitened, explained = brute(good)
    out = whitening.whitening_report(table(good + bad))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(out.dtypes)["deviation"] == "bigint"
    got = out.collect()
    k = min(d, 32)
    assert len(got) == len(good) * k and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, k + 1))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for c in range(1, k + 1):
        mine = sorted(((r.vec_id, r.deviation, r.whitened) for r in got if r.component == c), key=key)
        want = sorted(((i, x, w) for (i, _), x, w in zip(good, deviation, whitened[:, c - 1])), key=key)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        a, b = np.array([m[2] for m in mine]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert np.allclose([r.explained for r in got if r.component == c], explained[c - 1], rtol=1e-12)
    assert max(r.identity_error for r in got) < 1e-10


def test_tables_without_a_component(table):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        assert whitening.whitening_report(table(rows)).isEmpty()


def test_directions_without_variance_are_left_out(table):
    rng = np.random.default_rng(1)
    rows = [(i, [a, 2 * a, b, 5.0]) for i, (a, b) in enumerate(np.round(rng.normal(0, 3, (80, 2)) * 64) / 64)]
    got = whitening.whitening_report(table(rows, "double")).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9


def test_large_entries_stay_exact(table):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 3) * 10.0 ** rng.integers(0, 13)).tolist()) for i in range(60)]
    n, deviation, _, _ = brute(rows)
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(rows, "double")).collect()}
    assert {i: int(x) for i, x in got.items()} == {i: x for (i, _), x in zip(rows, deviation)}
    out = whitening.whitening_report(table([*rows, (99, [1e300, 0.0, -1e300])], "double")).collect()
    assert all(r.deviation is None for r in out if r.vec_id == 99) and all(math.isfinite(r.whitened) for r in out)


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for high in (5, 1 << 19, 1 << 40, 1 << 62):
        y = rng.integers(-high, high, (5_000, 3))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_divide_and_conquer_on_hard_spectra():
    rng = np.random.default_rng(5)
    for spectrum in ([1.0] * 6, [3.0, 1.0, -1.0, -3.0], [5, 5, 5, 1, 1, 0], np.geomspace(1, 1e-14, 20), np.linspace(1, 2, 50), [1, 1 + 1e-13, 1 - 1e-13, 0.5], [0.0] * 4, [2.0]):
        spectrum = np.sort(np.array(spectrum, float))[::-1]
        q = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.components(a, len(a))
        size = max(np.abs(spectrum).max(), 1e-300)
        assert np.abs(values - spectrum).max() <= 1e-13 * size * len(a)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 * len(a)
        assert len(whitening.components(a, 2)[0]) == min(2, len(a))


def test_the_polar_factor():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    u, values, v = np.linalg.svd(a)
    assert np.abs(whitening.polar(a) - u @ v).max() < 1e-12
