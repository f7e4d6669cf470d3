"""Whitening and vector codes against brute force over whole tables."""

import hashlib

import numpy as np
import pytest

from lingualake.llm import queries, vector_codes, whitening

SF = "/root/testdata/sf0.001"
ODD = [(5, [0.5, 1.0, -0.25, 2.0], 1), (2, [0.5, 1.0, -0.25, 2.0], 1), (2, [0.5, 1.0, -0.25, 2.0], 1), (9, None, 1), (8, [1.0, None, 0.0, 0.0], 2), (7, [float("nan"), 0.0, 0.0, 0.0], 2)]
ODD += [(6, [float("inf"), 0.0, 0.0, 0.0], None), (None, [1.5, -1.0, 0.25, 0.125], None), (1, [3.0, 2.0, 1.0, -7.0], None), (3, [-0.001, 4.0, 1.0, 0.0], 2), (4, [1.0, 1.0], 2), (0, [9.0, 8.0, 7.0, 5.0], 2)]


def frame(spark, rows):
    columns = "vec_id bigint, embedding array<float>, label int, id string, x string, n string, component string, part string"
    return spark.createDataFrame([(*r, *["q"] * 5) for r in rows], columns)


def good(rows):
    return [(i, v, c) for i, v, c in rows if v and len(v) == 4 and all(e is not None and np.isfinite(e) for e in v)]


def check_whitening(found, rows, dims):
    x = np.floor(256 * np.array([np.float32(v).astype(float) for _, v, _ in rows])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T, bias=True)
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    white = (x - sums / n) @ v[:, :4] / np.sqrt(e[:4])
    expected = {}
    for (i, _, _), w, row in zip(rows, white, x, strict=True):
        expected.setdefault((i, tuple(row)), []).append((w, sum(int(n * a - s) ** 2 for a, s in zip(row, sums, strict=True))))
    assert len(found) == 4 * len(rows)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r)
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
    signs = np.zeros(4)
    for (i, _), same in expected.items():
        w, deviation = same[0]
        got = np.array([by[i, deviation][k]["whitened"] for k in range(1, 5)])
        signs = np.where(signs == 0, np.sign(got * w), signs)
        assert got == pytest.approx(signs * w, abs=1e-6)


def test_whitening_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op12_whitening(spark, SF).collect(), rows, 64)


def test_whitening_of_odd_rows(spark):
    found = whitening.whiten(frame(spark, ODD)).withColumnRenamed("id", "vec_id").collect()
    check_whitening(found, good(ODD), 4)
    assert whitening.whiten(frame(spark, [])).collect() == []
    alone = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1)])).collect()
    assert len(alone) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in alone)
    line = whitening.whiten(frame(spark, [(k, [float(k), 0.0, 0.0], 1) for k in range(5)])).collect()
    assert [r["whitened"] is None for r in line if r["id"] == 3] == [False, True, True] and all(r["identity_error"] < 1e-9 for r in line)


def test_summaries_merge_losslessly():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 12)) * 300 + 10_000).astype(np.int64)
    whole, tree = whitening.summary(x), whitening._union(whitening.summary(x[k : k + 7]) for k in range(0, 400, 7))
    assert tree.n == 400 and tree.sums == whole.sums and tree.singular == pytest.approx(whole.singular, rel=1e-9)
    assert np.abs(np.sum(tree.vectors * whole.vectors, axis=1)) == pytest.approx(np.ones(12), abs=1e-9)


def test_many_summaries_take_several_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [(k, [float(x) for x in np.random.default_rng(k).normal(size=4)], 1) for k in range(60)]
    found = whitening.whiten(frame(spark, rows).repartition(9)).withColumnRenamed("id", "vec_id").collect()
    check_whitening(found, rows, 4)


def test_deviations_are_exact_or_raise(spark):
    far = [(1, [4e6, 0.0, 0.0, 0.0], 1), (2, [-4e6, 0.0, 1.0, 0.0], 1)]
    got = {r["id"]: r["deviation"] for r in whitening.whiten(frame(spark, far)).collect()}
    assert got == {1: 4 * ((4_000_000 * 256) ** 2 + 128**2), 2: 4 * ((4_000_000 * 256) ** 2 + 128**2)}
    with pytest.raises(Exception, match=r"long|int64|convert|large"):
        whitening.whiten(frame(spark, [(1, [4e9], 1), (2, [-4e9], 1)])).collect()


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.floor(1024 * np.array([np.float32(v).astype(float) for _, v, _ in rows])).astype(np.int64)
    cut = np.array_split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]
    near = lambda c, b: ((c[:, None, :] - b[None]) ** 2).sum(-1)
    for _ in range(rounds):
        for c, b in zip(cut, books, strict=True):
            at = near(c, b).argmin(axis=1)
            for e in set(at.tolist()):
                b[e] = [int(s) // int((at == e).sum()) for s in c[at == e].sum(axis=0)]
    distances = [near(c, b) for c, b in zip(cut, books, strict=True)]
    code = ["".join(f"{d[i].argmin():02x}" for d in distances) for i in range(len(x))]
    error = [sum(int(d[i].min()) for d in distances) for i in range(len(x))]
    label = {c: sum(e for e, r in zip(error, rows, strict=True) if r[2] == c) for c in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted((r[0] if r[0] is not None else -1, k, e, label[r[2]], digest) for r, k, e in zip(rows, code, error, strict=True))


def codes(df):
    return sorted((r["id"] if r["id"] is not None else -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.encode(df).collect())


def test_codes_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert codes(frame(spark, rows)) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    assert codes(frame(spark, ODD)) == brute_codes(good(ODD))
    assert codes(frame(spark, [])) == []
    rng = np.random.default_rng(2)
    few = [(k, [float(x) for x in rng.integers(-3, 3, 10)], k % 3) for k in range(40)] + [(100 + k, [1.0] * 10, None) for k in range(500)]
    assert codes(frame(spark, few)) == brute_codes(few)
    assert [r[1] for r in codes(frame(spark, [(1, [2.0, 3.0], 1)]))] == ["00000000"]


def test_bounds_hold_and_find_ties():
    rng = np.random.default_rng(7)
    for n, size in ((1, 3), (5, 1), (16, 4), (256, 16), (200, 2)):
        entries = rng.integers(-50, 50, (n, size))
        cells, wanted = vector_codes.Cells(entries), rng.integers(-80, 80, (700, size))
        whole = ((wanted[:, None, :] - entries[None]) ** 2).sum(-1)
        low, high = cells._bounds(wanted)
        assert (low.T <= whole).all() and (whole <= high.T).all()
        entry, distance = cells.nearest(wanted)
        assert (entry == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
