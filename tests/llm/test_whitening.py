"""Whitening against exact rational sums and plain covariances."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigrane.llm import whitening as W
from filigrane.llm.shared import prepare, table

DDL = "vec_id long, embedding array<double>, x string, component int"


def plain(rows):
    """The integer vectors of the usable rows, padded, and the distinct ones."""
    kept = [(i, [min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(v) + (0,) * (d - len(v))) for i, v in kept]
    return kept, sorted({v for _, v in kept})


def check(spark, rows, most=4):
    docs = spark.createDataFrame([(i, v, "s", 3) for i, v in rows], DDL).repartition(3)
    got = W.whitened(docs).collect()
    kept, fit = plain(rows)
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[float(sum((Fraction(v[i]) - Fraction(sums[i], n)) * (Fraction(v[j]) - Fraction(sums[j], n)) for v in fit) / n) for j in range(d)] for i in range(d)])
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:most], p[:, ::-1][:, :most]
    k = int((e > 1e-12 * e[0]).sum())
    assert len(got) == len(kept) * k and {r["component"] for r in got} == set(range(1, k + 1))
    want = {}
    for i, v in kept:
        z = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)]) @ p / np.sqrt(np.where(e > 0, e, 1))
        want.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(v, sums))), []).append(z)
    for r in got:
        z = want[r["vec_id"], int(r["deviation_text"])]
        c = r["component"] - 1
        assert any(math.isclose(abs(r["whitened"]), abs(float(w[c])), rel_tol=1e-6, abs_tol=1e-6) for w in z)
        assert r["n"] == n and r["identity_error"] <= 1e-4 and math.isclose(r["explained"], e[c] / np.trace(cov), rel_tol=1e-9)
        assert r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 2**63 else None)
    return got


def test_whitening_equals_plain_sums(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1, 0.5, 0.4, 0.3] + 5).tolist()) for i in range(300)]
    rows += [(i + 900, rows[i][1]) for i in range(40)] + [(5, rows[9][1]), (None, rows[8][1]), (1001, None), (1002, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] + [0.0] * 5)]
    rows += [(1005, [1.0, 2.0]), (1006, []), (1007, [-0.0] * 6)]
    got = check(spark, rows)
    assert {1005, 1006, 1007, None} <= {r["vec_id"] for r in got}


def test_huge_components_and_low_rank(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 3)) * 1e15)])
    check(spark, [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [5.0, 1.5]), (3, [1e15, -9.0])])
    line = [(i, [float(i), 2.0 * i]) for i in range(20)]
    assert {r["component"] for r in check(spark, line)} == {1}


def test_nothing_to_whiten(spark):
    prepare(spark)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert W.whitened(spark.createDataFrame([(i, v, "", 0) for i, v in rows], DDL)).collect() == []
    with pytest.raises(ValueError):
        W.whitened(spark.createDataFrame([(1, [1.0] * (W.MOST_DIMENSIONS + 1), "", 0)], DDL))


def test_query_on_the_table(spark, sf):
    prepare(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    got = W.op12_embedding_whitening(spark, sf)
    assert got.count() == 4 * len(rows)
    kept, fit = plain(rows)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    want = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in kept}
    assert {r["vec_id"]: r["deviation"] for r in got.filter(F.col("component") == 2).collect()} == want


def test_residues_give_exact_products():
    rng = np.random.default_rng(7)
    x = rng.integers(-(2**63), 2**63 - 1, (5000, 3))
    moduli = W.primes(2 * 5000 * 2**126)
    assert len(set(moduli)) == len(moduli) and all(2**19 < p < 2**20 for p in moduli)
    parts = W.residue_products(x, moduli)
    for i in range(3):
        for j in range(3):
            want = sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))
            assert W.rebuilt([int(m[i, j]) for m in parts], moduli) == want


def test_packed_vectors():
    same = [[0.5, -0.25], [0.5, -0.25, 0.0], [0.501, -0.2499]]
    assert len(set(W.packed(same[:2]))) == 1
    assert W.unpacked(W.packed([[1e300, -1e300, 200.0], []]), 3).tolist() == [[2**63 - 1, -(2**63), 51200], [0, 0, 0]]
