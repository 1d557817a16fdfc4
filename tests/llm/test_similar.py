"""The Jaccard join against all pairs, and its parts against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from filigrane.llm import jaccard_join as J
from filigrane.llm.shared import prepare

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


# so that few copies already make heavy shingles and blocks; and, with none of them told in advance, long light lists
@pytest.mark.parametrize("heavy,block,most_heavy", [(3, 400, J.MOST_HEAVY), (4, 10_000, 0)])
def test_components_equal_brute_force(spark, heavy, block, most_heavy):
    prepare(spark)
    rng = random.Random(heavy)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(12):  # families of near copies, by few and by many edits
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 12, 14, 30, 80, 300]))]
        for _ in range(rng.randrange(1, 14)):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 20 + rng.randrange(2)))))
        rows += [" ".join(base[: -rng.randrange(1, 3)]) for _ in range(2)] + [" ".join(base).upper() + "\n"]
    rows += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))]) for _ in range(25)]
    rows += ["", "  ", None, "one", "ONE", "one  two\tthree", "É é", "é é", " ".join(rng.choice(vocabulary) for _ in range(5000))]
    rng.shuffle(rows)
    ids = [(None if i % 41 == 40 else i // 2 if i % 29 == 28 else i, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame([(d, t, 1, "a", 5) for d, t in ids], "doc_id long, text string, node long, label string, n long").repartition(5)
    got = J.similar_components(docs, heavy=heavy, block_shingles=block, most_heavy=most_heavy).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=repr) == brute(ids)


def test_empty_table(spark):
    prepare(spark)
    assert J.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_sets():
    texts = ["A b c d e f", "a B c d e f", "a b c", "", None, " a\x0bb\x0cc d e f  f", "x " * 50, "a b c d e"]
    flat, sizes = J.shingle_sets(pa.array(texts))
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    assert (sets[0] == sets[1]).all() and J.set_id(sets[0]) == J.set_id(sets[1]) != J.set_id(sets[2])


def test_bounds():
    assert J.small_boundary() == 9
    for n in range(1, 40):
        for m in range(1, 40):
            for o in range(min(n, m) + 1):
                linked = 100 * o >= 80 * (n + m - o)
                assert linked == (o >= J.needed(n, m))
                if linked:
                    assert J.needed(n, m) in J.overlap_sizes(n) and J.needed(n, m) in J.overlap_sizes(m) and n - o < J.prefix_size(n)


def test_deltas():
    x = np.sort(np.random.default_rng(0).integers(0, 5000, 300))
    assert (J._numbers(J._deltas(x)) == x).all() and J._numbers(J._deltas(x[:0])).size == 0


def test_components_of_a_path(spark):
    rng = random.Random(5)
    name = rng.sample(range(-(10**9), 10**9), 60)
    edges = [(name[i], name[i + 1]) for i in range(49)] + [(name[50], name[i]) for i in range(51, 60)]
    got = {r.node: r.label for r in J.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[x] for x in name[:50]}) == 1 == len({got[x] for x in name[50:]}) and got[name[0]] != got[name[55]]


def test_sketches_of_tables_of_any_size():
    for power in range(10, 48):
        bits, ranges = J.sketch_size(1 << power)
        shingles = (1 << power) / 6
        assert shingles / ranges <= 1.5e8 and (1 << bits) // ranges * 8 <= 1 << 28
        assert shingles / (1 << bits) <= 100 or power > 46
