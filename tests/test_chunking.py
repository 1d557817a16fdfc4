"""The recursive splitter by its rules."""

import random

from pyspark.sql import functions as F

from filigrane.operators import chunking


def pieces_of(text, size, separators):
    """A text cut at the first separator that occurs, and what is too long at later ones; separators stay at the ends."""
    if len(text) <= size:
        return [text] if text else []
    here = next((s for s in separators if s and s in text), None)
    if here is None:
        return [text[i : i + size] for i in range(0, len(text), size)]
    later = separators[separators.index(here) + 1 :]
    parts = text.split(here)
    cut = [p + here for p in parts[:-1]] + [parts[-1]]
    return [x for p in cut for x in pieces_of(p, size, later)]


def plain(text, size, overlap, separators):
    """Pieces gathered up to the size; each chunk repeats the last pieces of the one before, as far as they fit in the overlap."""
    out, held = [], []
    for p in pieces_of(text, size, separators):
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held = held[1:]
        held = held + [p]
    return [c.strip() for c in [*out, "".join(held)] if c.strip()]


def test_recursive_split_equals_the_plain_rule(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word ", "a", "é", "\n", "\n\n", "  ", "x" * rng.randrange(1, 60), ". "]) for _ in range(rng.randrange(1, 80))) for _ in range(120)] + ["", " ", "x" * 500, "\n\n" * 90, "one\n\ntwo"]
    for size, overlap in ((40, 10), (100, 0), (25, 25)):
        split = chunking.recursive_split(size, overlap)
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", split(F.col("t")).alias("x")).collect()
        got = {r.i: r.x for r in rows}
        for i, t in enumerate(texts):
            assert got[i] == plain(t, size, overlap, ("\n\n", "\n", " ", ""))
            assert all(len(c) <= size for c in got[i]) and set("".join(t.split())) <= set("".join(got[i]))


def test_recursive_split_makes_parents(spark):
    docs = spark.createDataFrame([("f", "one two\n\nthree four"), ("g", None), ("h", " \n")], "source string, content string")
    rows = chunking.parents(docs, F.col("source"), F.col("content"), split=chunking.recursive_split(10, 0)).orderBy("parent_idx").collect()
    assert [(r.source, r.parent_idx, r.content) for r in rows] == [("f", 0, "one two"), ("f", 1, "three four")]
