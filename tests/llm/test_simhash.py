"""SimHash near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from filigrane.llm import simhash as S
from filigrane.llm.shared import prepare

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, differing=3):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= differing:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "x", 1.5) for d, t in rows], "doc_id long, text string, print string, node double").repartition(3)
    return sorted(map(tuple, S.near_duplicates(docs, **how).collect()), key=repr)


@pytest.mark.parametrize("bucket", [6, 512])  # with 6, buckets are cut again
def test_near_duplicates_equal_brute_force(spark, bucket):
    prepare(spark)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "a lonely row"), (None, None), (7, ""), (7, "  \t\n "), (8, None), (9, "One"), (10, "one two"), (11, "ONE two"), (12, "Ä  x y \x1c z \x85 q"), (13, "ä  x y \x1c z \x85 q")]
    for f in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 40, 300]))]
        for c in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 * f + c, rng.choice([" ", "\n", "  "]).join(own)))
    rows += rows[20:24] + [(5, rows[-1][1])]
    want = brute(rows)
    assert found(spark, rows, bucket=bucket) == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_links_join_what_any_pair_joins(spark):
    prepare(spark)
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 1 << 9, 200).astype(np.uint64)  # many that differ in few bits
    far = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    chain = np.array([sum(1 << b for b in range(3 * k)) << 1 for k in range(1, 15)], np.uint64) ^ np.uint64(1 << 63)
    prints = np.unique(np.concatenate([dense << np.uint64(40), far, far[:50] ^ np.uint64(0b1001 << 20), far[50:90] ^ np.uint64(0b11011 << 20), chain]))
    for differing, bucket in ((3, 16), (0, 16), (1, 8)):
        edges = S.links(spark, spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long"), differing, bucket).collect()

        def groups(pairs):
            root = {int(n): int(n) for n in S.mixed(prints)}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for u, v in pairs:
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
            return {n: find(n) for n in root}

        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= differing
        names = S.mixed(prints).tolist()
        assert groups((e["u"], e["v"]) for e in edges) == groups((names[i], names[j]) for i, j in np.argwhere(near) if i < j)


def test_every_close_pair_shares_a_bucket():
    rng = random.Random(1)
    for level in (0, 1, 2):
        masks = S.block_masks(3, level)
        assert len(masks) == 4 ** (level + 1)
        for _ in range(200):
            apart = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not apart & m for m in masks)


def test_whole_texts_are_hashed_slice_by_slice(monkeypatch):
    text = (" ".join(f"Word{i % 977}" for i in range(3000)) + " \n").encode()
    want = [plain(text.decode())]
    assert S.fingerprints([text]).tolist() == want
    monkeypatch.setattr(S, "COUNTED", 64)
    assert [x for w in (len(h) for h in S.shingle_hashes(text)) for x in [w]] == [2998]
    monkeypatch.setattr(S.word_slices, "__defaults__", (50,))
    assert S.fingerprints([text, None, b"a b", b" a  b " + b" " * 200, b"x" * 300]).tolist() == want + [0, plain("a b"), plain("a b"), plain("x" * 300)]


def test_empty_table_and_numbers(spark):
    prepare(spark)
    assert found(spark, []) == []
    assert len(set(S.mixed(np.arange(10000, dtype=np.uint64)).tolist())) == 10000
