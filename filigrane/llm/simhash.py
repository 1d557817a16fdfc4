"""SimHash near duplicates: pigeonhole blocks of the fingerprints, joined on blocks, verified by Hamming distance.

Fingerprints that differ in few bits agree on a whole block, whichever way the bits are cut into one block more.
So each distinct fingerprint goes to one bucket a block, and a bucket's fingerprints are compared with each other.
A bucket that holds too many is cut again: the bits it doesn't fix are split into blocks in the same way, so
that no pair is lost, until every bucket is small.  A bucket leaves the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.jaccard_join import components
from filigrane.llm.shared import annotated, lean, prepare, staged, table

SEED = 42
SHINGLE = 3
DIFFERING = 3
#: Fingerprints that are compared with each other; larger buckets are cut again.
BUCKET = 512
#: Ways to cut that are the last: what is left in a bucket then is compared, however much.
MOST_PATHS = 16_384
#: Bytes of a text that are cut into words at a time, and hashes whose bits are counted at a time.
SLICE_BYTES = 1 << 20
COUNTED = 1 << 15


def word_slices(text: bytes, carried: int, size: int = SLICE_BYTES):
    """Lists of a text's words (lower case A-Z), slice by slice; each list but the first repeats so many words of what precedes."""
    import re

    blank, last, at = re.compile(rb"[\x20\x09-\x0d]"), [], 0
    while at < len(text):
        cut = blank.search(text, at + size)
        end = cut.end() if cut else len(text)
        words = last + text[at:end].lower().split()
        yield words
        last, at = words[-carried:], end


def shingle_hashes(text: bytes):
    """XXH64 of every shingle of a text, repeats included, as arrays; a shorter text is one shingle, one without words none."""
    import xxhash

    digest, short = xxhash.xxh64_intdigest, []
    made = False
    for words in word_slices(text, SHINGLE - 1):
        if len(words) < SHINGLE:
            short = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        made = True
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), np.uint64, len(words) - SHINGLE + 1)
    if short and not made:
        yield np.array([digest(b" ".join(short), SEED)], np.uint64)


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """uint64 fingerprints: a bit is 1 if it is set in over half the hashes of a text's shingles."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def count():
        nonlocal size
        if held:
            flat, at = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
            bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, owners, np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            held.clear()
            owners.clear()
            size = 0

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text or b""):
            totals[i] += len(hashes)
            for part in np.split(hashes, range(COUNTED, len(hashes), COUNTED)):
                held.append(part)
                owners.append(i)
                size += len(part)
                if size >= COUNTED:
                    count()
    count()
    return np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def mixed(prints: np.ndarray) -> np.ndarray:
    """Numbers of the fingerprints, one to one and spread evenly, as int64."""
    x = prints.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def block_masks(differing: int, level: int) -> list[int]:
    """The fixed bits of each path of so many cuts after the first, in order of the paths."""
    masks = [0]
    for _ in range(level + 1):
        cut = []
        for fixed in masks:
            free = [b for b in range(64) if not fixed >> b & 1]
            cut += [fixed | sum(1 << b for b in own.tolist()) for own in np.array_split(np.array(free, np.int64), differing + 1)]
        masks = cut
    return masks


def forest(prints: np.ndarray, differing: int) -> list[tuple[int, int]]:
    """Edges that join just those of distinct fingerprints that links join; linked ones are compared once only."""
    out, left = [], prints
    while left.size > 1:
        head, left = left[0], left[1:]
        queue = [head]
        while queue and left.size:
            near = np.bitwise_count(left ^ queue.pop()) <= differing
            if near.any():
                hit, left = left[near], left[~near]
                out += [(int(head), int(h)) for h in hit]
                queue.extend(hit)
    return out


def links(spark: SparkSession, prints: DataFrame, differing: int = DIFFERING, bucket: int = BUCKET) -> DataFrame:
    """u, v: numbers (see mixed) of distinct fingerprints, edges of forests that join just what links join.

    prints: print, each once. Runs a job for each cut.
    """
    if not 0 <= differing <= 7:
        raise ValueError("fingerprints of 64 bits are cut for at most 7 differing bits")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    n, level = prints.count(), 0
    while level < 3 and n * 4 > bucket << min(64, block_masks(differing, level)[0].bit_count()):
        level += 1  # blocks so large that a bucket is small on average
    here = prints.select("print", F.lit(0).alias("path"))
    parents = 1
    found = None

    def solve(batches):
        import pyarrow as pa

        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not part:
                continue
            keys = np.column_stack([part[0].column(c).to_numpy() for c in ("path", "block")])
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            last = int(new[-1]) if new.size else 0
            rest = part[0].slice(last)
            yield from edges(part[0].slice(0, last).column("print"), new)
        if rest is not None:
            yield from edges(rest.column("print"), np.zeros(0, np.int64))
        lean()

    def edges(values, cuts):
        import pyarrow as pa

        out = []
        for own in np.split(values.to_numpy().view(np.uint64), cuts[cuts < len(values)]):
            out += forest(own, differing)
        if out:
            u, v = mixed(np.array(out, np.uint64).reshape(-1, 2)).T
            yield pa.RecordBatch.from_arrays([pa.array(u.copy()), pa.array(v.copy())], names=["u", "v"])

    while True:
        masks = block_masks(differing, level)
        step = len(masks) // parents
        cut = spark.createDataFrame([(k // step, k, signed(m)) for k, m in enumerate(masks)], "parent int, child int, mask long")  # a fixed number of rows a level
        rows = here.join(F.broadcast(cut), F.col("path") == F.col("parent")).select("print", F.col("child").alias("path"), F.col("print").bitwiseAND(F.col("mask")).alias("block"))
        sizes = rows.groupBy("path", "block").agg(F.count("*").alias("size")).filter("size > 1")
        rows = staged(spark, rows.join(sizes, ["path", "block"]), "buckets")
        # no bucket can be larger, as fingerprints are distinct; for the default it is so after seven cuts
        whole = len(masks) >= MOST_PATHS or all(64 - m.bit_count() < bucket.bit_length() for m in masks)
        fine = rows if whole else rows.filter(F.col("size") <= bucket)
        own = fine.select("path", "block", "print").repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(solve, "u long, v long")
        found = own if found is None else found.unionByName(own)
        here = rows.filter(F.col("size") > bucket).select("print", "path")
        if whole or here.isEmpty():
            return found
        level, parents = level + 1, len(masks)


def near_duplicates(docs: DataFrame, differing: int = DIFFERING, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links reach from a row, itself included.

    docs: doc_id, text; other columns, whatever their names, are ignored.  Fingerprints link if they differ in so
    few bits.  A null or empty text, or one without words, has fingerprint zero, which links like any other.  Texts
    of any length are read slice by slice.  Rows that repeat, or share a doc_id, are rows of their own; those with
    a null doc_id link like others but give no component its name: where all rows of one lack a doc_id, it is null.
    An empty table gives no rows.  Runs jobs, and stages what they find.
    """
    import pyarrow as pa

    spark = docs.sparkSession

    def make():
        def work(texts):
            found = fingerprints(texts.cast(pa.binary()).to_pylist())
            return [pa.array(found.view(np.int64)), pa.array(mixed(found))]

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(spark, annotated(source, make, "print long, node long", ["doc_id"], 1_000_000), "prints")
    least = staged(spark, rows.groupBy("print", "node").agg(F.min("doc_id").alias("least")), "least")
    labels = components(spark, links(spark, least.select("print"), differing, bucket))
    groups = staged(spark, least.join(labels, "node").select("node", "label", "least"), "groups")
    named = groups.join(groups.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    named = named.unionByName(least.join(groups, "node", "left_anti").select("node", F.col("least").alias("component_id")))
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
