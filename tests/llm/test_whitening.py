"""Whitening against numpy's eigenvectors: updates, merging, deflation, degenerate and odd tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmaflow.llm import whitening as wh
from tests.conftest import SF_MID


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


def close(s, x):
    size = max(np.abs(scatter(x)).max(), 1)
    assert np.abs(s.v @ np.diag(s.d) @ s.v.T - scatter(x)).max() <= 1e-11 * size
    assert np.abs(s.v.T @ s.v - np.eye(len(s.d))).max() <= 1e-11
    assert np.allclose(s.mean, x.mean(axis=0)) and s.n == len(x) and (np.diff(s.d) >= 0).all()


def spectrum(x):
    s = wh.Spectrum.empty(x.shape[1])
    for row in x:
        s.add(row)
    return s


@pytest.mark.parametrize(("n", "d"), [(1, 3), (2, 1), (5, 8), (300, 6), (700, 40)])
def test_updates(n, d):
    x = np.random.default_rng(n).integers(-500, 500, (n, d)).astype(float)
    close(spectrum(x), x)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.lists(st.lists(st.integers(-3, 3), min_size=d, max_size=d), min_size=1, max_size=30)))
def test_repeated_eigenvalues_and_constant_dimensions(rows):
    x = np.array(rows, float)
    close(spectrum(x), x)
    half = len(x) // 2
    if half:
        s = spectrum(x[:half])
        s.merge(spectrum(x[half:]))
        close(s, x)


def test_roots_interlace():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 30):
        d, z = np.sort(rng.normal(size=n)), rng.normal(size=n) + 0.1
        pole, x = wh.secular_roots(d, z * z, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        assert np.allclose(d[pole] + x, want, atol=1e-13)


def brute(rows, components=4):
    """(vec_id, component) -> (n, deviation, whitened, explained), by numpy on all rows."""
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in rows]).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    y = (x - s / n) @ v / np.sqrt(e)
    return n, dev, y, e / np.trace(c.T @ c / n)


def check(got, rows):
    n, dev, y, explained = brute(rows)
    place = {i: k for k, (i, _) in enumerate(rows)}
    for k in range(y.shape[1]):
        mine = [r for r in got if r.component == k + 1]
        at = [place[r.vec_id] for r in mine]
        assert len(mine) == len(rows)
        white, want = np.array([r.whitened for r in mine]), y[at, k]
        assert np.allclose(white * np.sign(white @ want), want, atol=1e-9)
        assert np.allclose([r.explained for r in mine], explained[k], rtol=1e-9)
        assert [r.deviation for r in mine] == [dev[i] for i in at] and {r.n for r in mine} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    check(wh.op11_whitening(spark, SF_MID).collect(), rows)


def written(spark, rows, tmp_path, kind="array<float>"):
    spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], f"vec_id long, embedding {kind}, x string, id string, n string").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return wh.op11_whitening(spark, str(tmp_path)).collect()


def test_copies_and_rows_that_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(8)
    good = [(i, [float(v) for v in rng.normal(size=6) * [3, 2, 1, 1, 0.5, 0.1]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(200)]  # one vector holds most rows
    bad = [(300, None), (301, [float("nan")] * 6), (302, [float("inf"), *[0.0] * 5]), (303, [None, *[0.0] * 5]), (304, []), (305, [1.0] * 5)]
    got = written(spark, good + bad, tmp_path, "array<double>")
    check(got, good)
    assert len(written(spark, [*good, good[3], (None, good[4][1])], tmp_path, "array<double>")) == 4 * 262


def test_degenerate_tables(spark, tmp_path):
    assert written(spark, [], tmp_path) == [] and written(spark, [(1, None)], tmp_path) == []
    one = written(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], tmp_path)
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    line = written(spark, [(i, [float(i), 0.0, 0.0]) for i in range(5)], tmp_path)
    assert {r.component for r in line} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in line)


def test_deviations_are_exact_beyond_64_bit_products():
    x = np.array([[3, -5], [4, 10**12]])
    assert wh.deviations(x, 3, [10, 3 * 10**12]) == [sum((3 * a - b) ** 2 for a, b in zip(r, (10, 3 * 10**12))) if i else None for i, r in enumerate(x.tolist())]
