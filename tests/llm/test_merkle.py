"""The manifest against a plain recursion over sorted rows, and against its SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from filigrane.llm import merkle as M
from filigrane.llm.shared import prepare, remainder, table
from pyspark.sql import functions as F

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests, arity):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def way(tree, i, digest, arity):
    path = ""
    for nodes in tree[:-1]:
        first = i // arity * arity
        run = nodes[first : first + arity]
        path += "".join(run[: i - first] + run[i - first + 1 :])
        run[i - first] = digest
        digest, i = h(*run), i // arity
    return path, digest


def plain(rows, arity=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    top = levels([trees[g][-1][0] for g in names], arity)
    out = []
    for at, g in enumerate(names):
        for i, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tried = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                tried = leaf((*row[:3], row[3] + 1, row[4]))
            low, got = way(trees[g], i, tried, arity)
            high, got = way(top, at, got, arity)
            out.append((row[0], own, trees[g][-1][0], top[-1][0], h(low + high), got, got == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", leaf string, part int").repartition(4)
    return sorted(map(tuple, M.manifest(docs, remainder(F.col("doc_id"), 7) == 0, **how).collect()), key=repr)


def made(n, langs, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), rng.choice(["a", None, ""]), rng.choice(langs), rng.choice([None, 5, 2**63 - 1, -3]), rng.choice([None, "", "é€ text", "x" * 300])) for _ in range(n)]
    return rows + rows[:3] + [(None, "s", langs[0], 1, "t"), (7, None, None, None, None), (rows[0][0], "other", rows[0][2], 1, "t")]


@pytest.mark.parametrize("n,langs,arity,part_rows,fan_in", [(150, ["en", None, "de", "é", ""], 2, 8, 2), (150, ["en"], 3, 5, 3), (90, [f"l{k}" for k in range(60)], 2, 10, 32)])
def test_manifest_equals_plain_recursion(spark, n, langs, arity, part_rows, fan_in):
    prepare(spark)
    rows = made(n, langs, n)
    got = found(spark, rows, arity=arity, part_rows=part_rows, fan_in=fan_in)
    assert got == plain(rows, arity)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_single_row_and_no_row(spark):
    prepare(spark)
    row = (1, "s", "en", 4, "text")
    assert found(spark, [row]) == [(1, leaf(row), leaf(row), leaf(row), sha256(b"").hexdigest(), leaf(row), True)]
    assert found(spark, []) == []


def test_fragments_merge_in_any_grouping():
    rng = random.Random(4)
    for n in (1, 2, 7, 33, 100):
        for arity in (2, 3):
            digests = [h(str(i)).encode() for i in range(n)]
            root = levels([d.decode() for d in digests], arity)[-1][0].encode()
            order = list(range(n))
            rng.shuffle(order)
            forests = [{(0, i): digests[i]} for i in order]
            while len(forests) > 1:
                a, b = forests.pop(rng.randrange(len(forests))), forests.pop()
                forests.insert(0, M.merged(a | b, n, arity)[0])
            ((level, at), digest), = forests[0].items()
            assert (at, digest) == (0, root)
            grown = M.climbed(digests, 0, n, arity)
            assert grown[-1][1] == [root] and grown[-1][0] == 0


def test_manifest_equals_sql(spark, sf):
    prepare(spark)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(M.OP13_SQL).fetchall()
    assert sorted(map(tuple, M.op13_merkle_manifest(spark, sf).collect())) == sorted(want)
    assert table(spark, sf, "documents").count() == len(want)
