"""Inverted lists: exact search against brute force, recall of the approximate one."""

import numpy as np
import pytest

from filigrane.operators import ivf


def best(vectors, queries, k):
    ids, x = [i for i, _ in vectors], ivf.unit(np.array([v for _, v in vectors], float))
    out = {}
    for q, v in queries:
        scores = np.round(x @ ivf.unit(np.array([v], float))[0], 12)
        out[q] = [(ids[i], scores[i]) for i in sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]]
    return out


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["key"], r["score"]))
    return out


def test_lists_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    x[200:500] = x[0]  # one vector that many rows share
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8)]
    table = spark.createDataFrame(vectors + odd + [(6000, [0.0] * 16)], "id long, v array<double>").repartition(4)
    ivf.write_lists(table, "id", "v", f"{tmp_path}/i")
    queries = [(q, x[q].tolist()) for q in range(0, 1500, 60)] + [(7000, rng.normal(size=16).tolist()), (7001, [0.0] * 16)]
    asked = spark.createDataFrame(queries + [(7002, None), (7003, [])], "query_id long, vector array<double>")
    want = best(vectors + [(6000, [0.0] * 16)], queries, 10)
    exact = told(ivf.search_lists(spark, f"{tmp_path}/i", asked, 10, probes=1, exact=True).collect())
    assert {q: [i for i, _ in v] for q, v in exact.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    near = told(ivf.search_lists(spark, f"{tmp_path}/i", asked, 10, probes=4).collect())
    recall = np.mean([len({i for i, _ in near.get(q, [])} & {i for i, _ in want[q]}) / 10 for q, _ in queries[:-1]])
    assert recall >= 0.9


def test_recall_on_the_table(spark, sf, tmp_path):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet").collect()]
    ivf.write_lists(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", f"{tmp_path}/i")
    queries = [r for r in rows if r[0] % 100 == 0]
    want = best(rows, queries, 10)
    near = told(ivf.search_lists(spark, f"{tmp_path}/i", spark.createDataFrame(queries, "query_id long, vector array<float>"), 10).collect())
    assert np.mean([len({i for i, _ in near[q]} & {i for i, _ in want[q]}) / 10 for q, _ in queries]) >= 0.9


def test_nothing_to_search(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    ivf.write_lists(none, "id", "v", f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert ivf.search_lists(spark, f"{tmp_path}/i", asked, 3).collect() == []
    with pytest.raises(Exception, match="length"):
        ivf.write_lists(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>"), "id", "v", f"{tmp_path}/j")
