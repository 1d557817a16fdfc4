"""N-gram Jaccard join: size-aware, heavy and light, exact.

Two documents link when the Jaccard similarity of their sets of word shingles is SIMILAR hundredths or more.

* Small sets enumerate all their subsets of the sizes in which two linked sets must overlap; such a subset is
  one key.  The boundary is where the number of subsets passes what inverted lists would cost.
* Larger sets put the first floor(n/5)+1 shingles, in one global order, into inverted lists: linked sets must
  meet there.  Light shingles come first in the order, heavy ones last, the heaviest at the end, so a heavy
  list is read only by sets that consist of heavy shingles for four fifths.  Pairs from a light list, which is
  short by definition, must pass the bound on their overlap that positions give.  A heavy list gives a star.
* What may link lies in one component of these candidates.  Each component's sets are brought together once
  and compared exactly; components over BLOCK_SHINGLES shingles are cut into blocks, compared two at a time.

Equal sets are one node from the start, so that copies cost nothing.  Which shingles are heavy comes from
counts over all documents; the counts only set the order, and any order gives the same links.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.llm.shared import column, gathered, prepare, staged, table

WORDS = 5
#: Link when 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: A shingle in more documents than this is heavy.
HEAVY = 32
#: Heavy shingles that are put last, the heaviest of all; a bound on what is broadcast (12 bytes each).
MOST_HEAVY = 1 << 20
#: Subsets a set may enumerate for each shingle it would put into inverted lists.
SUBSET_COST = 5
#: Shingles of a cell that are compared in one go; a larger component is cut into blocks of so many.
BLOCK_SHINGLES = 250_000
#: Sets to compare up to which their numbers are broadcast to the texts (about 100 bytes each); beyond, both are shuffled.
BROADCAST_ROWS = 200_000
#: Cells that they name in all, some 24 bytes each: a set of a large component names one for each of its blocks.
BROADCAST_CELLS = 1_000_000
#: Bytes of the texts whose sets are made together, and shingles that a task counts before it passes the counts on.
BATCH_BYTES = 2_500_000
COUNTED = 1_000_000
_LOW = bytes([32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SALTS = 64
#: Kinds of rows of the lists: a subset of a small set, a light shingle, a heavy one, and one row about a set:
#: where its prefix ends in the order, and how many heavy shingles are in it.
_SUBSET, _LIGHT, _HEAVY, _ABOUT = -1, 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles, one set after the other, and the sets' sizes.

    texts: an Arrow array of strings; a null text is empty.  A text of fewer than WORDS words has its whole
    sequence as one shingle, one without words the empty set.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    n = len(texts)
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if n else 0
    low = bytes(memoryview(texts.buffers()[2] or b"")[first : first + int(sizes.sum())]).translate(_LOW)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    split = pc.split_pattern(pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(low)), " ")
    words = split.flatten().dictionary_encode()
    own = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    real = np.fromiter(map(len, own), np.int64, len(own)) > 0
    code = words.indices.to_numpy()
    keep = real[code] if len(own) else np.zeros(0, bool)
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))[keep]
    word = mixed(hashes[code[keep]]) if len(own) else np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=n)
    ends = np.cumsum(count)
    out, sizes = [], np.zeros(n, np.int64)
    total = word.copy()
    if len(word) >= WORDS:
        total = word[: len(word) - WORDS + 1].copy()
        for k in range(1, WORDS):
            total = total * _M1 + word[k : len(word) - WORDS + 1 + k]
        total = mixed(total)
    for i, (a, b) in enumerate(zip((ends - count).tolist(), ends.tolist(), strict=True)):
        if b - a >= WORDS:
            s = np.unique(total[a : b - WORDS + 1])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = h * _M1 + word[k : k + 1]
            s = mixed(h ^ np.uint64(0x5555))
        else:
            continue
        sizes[i] = s.size
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set; 2 of 10**9 different sets share one with a chance of 3 in 100."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def needed(n: int, m: int, similar: int = SIMILAR) -> int:
    """The smallest overlap of linked sets of sizes n and m."""
    return -(-similar * (n + m) // (100 + similar))


def overlap_sizes(n: int, similar: int = SIMILAR) -> list[int]:
    """The overlaps that a set of n shingles may need with a linked one."""
    return sorted({c for m in range(-(-similar * n // 100), 100 * n // similar + 1) if (c := needed(n, m, similar)) <= min(n, m)})


def prefix_size(n: int, similar: int = SIMILAR) -> int:
    """A set shares more than n - this many shingles with any linked one."""
    return n - -(-similar * n // 100) + 1


def small_boundary(similar: int = SIMILAR, cost: int = SUBSET_COST) -> int:
    """The largest size up to which enumerating subsets costs no more than inverted lists."""
    n = 1
    while sum(comb(n + 1, c) for c in overlap_sizes(n + 1, similar)) <= cost * prefix_size(n + 1, similar):
        n += 1
    return n


def _deltas(sorted_numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences, seven bits a byte, the low ones first; a byte over 127 is not a difference's last."""
    d = np.diff(sorted_numbers, prepend=0)
    sizes = 1 + sum(((d >> 7 * k) > 0).astype(np.int64) for k in range(1, 9))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[starts[has] + k] = (d[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out.tobytes()


def _numbers(deltas: bytes) -> np.ndarray:
    octets = np.frombuffer(deltas, np.uint8)
    if not octets.size:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(octets < 128)
    sizes = np.diff(ends, prepend=-1)
    starts = ends + 1 - sizes
    place = np.arange(octets.size) - np.repeat(starts, sizes)
    return np.cumsum(np.add.reduceat((octets & 127).astype(np.int64) << 7 * place, starts))


def heavy_buckets(counted: list[bytes], size: int, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a range of so many that lists of ascending numbers (_deltas) name more than heavy times, and how often.

    The work follows the numbers in the lists: how many lists there are grows with the table, as does a range's share of it.
    """
    total = np.zeros(size, np.int64)
    for deltas in counted:
        numbers = _numbers(deltas)
        first = np.flatnonzero(np.diff(numbers, prepend=-1))
        total[numbers[first]] += np.diff(first, append=numbers.size)
    at = np.flatnonzero(total > heavy)
    return at, total[at]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (u, v): one label a component, one of its nodes.

    Every node takes its smallest neighbour's number, and edges shrink to those between different labels,
    until none is left.  Numbers are hashes, so that each round merges a share of the nodes in any graph.
    """
    edges = staged(spark, edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while True:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(spark, ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        if labels is None:
            labels = least.select(F.col("u").alias("node"), F.col("m").alias("label"))
        else:
            labels = staged(spark, labels.join(least.select(F.col("u").alias("label"), "m"), "label", "left").select("node", F.coalesce("m", "label").alias("label")), "labels")
        ends = edges.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("u")).join(least, "u").select("a", F.col("m").alias("b")).filter("a <> b")
        edges = staged(spark, ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def link_forest(groups: list[tuple[list[int], list[np.ndarray], list[bool] | None]], similar: int) -> list[tuple[int, int]]:
    """For each group (nodes, sorted sets, sides) edges that join just the nodes that links join.

    sides: for two blocks, which a node is of; only pairs across are compared.  None: all pairs.
    """
    out: list[tuple[int, int]] = []
    for nodes, sets, sides in groups:
        sizes = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(sizes, kind="stable")
        flat = np.concatenate([sets[i] for i in order.tolist()])
        sizes = sizes[order]
        _, code, freq = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(order)), sizes)
        shared = freq[code] > 1
        code, owner = code[shared], owner[shared]
        lanes = np.searchsorted(owner, np.arange(len(order) + 1))
        side = None if sides is None else np.array(sides)[order]
        root = list(range(len(order)))

        def find(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def labels(lo: int, hi: int) -> np.ndarray:
            return np.fromiter(map(find, range(lo, hi)), np.int64, hi - lo)

        step = 256
        for a in range(0, len(order), step):
            a2 = min(len(order), a + step)
            own = code[lanes[a] : lanes[a2]]
            if not own.size:
                continue
            local, compact = np.unique(own, return_inverse=True)
            left = np.zeros((a2 - a, local.size), np.float32)
            left[owner[lanes[a] : lanes[a2]] - a, compact] = 1
            most = 100 * int(sizes[a2 - 1]) // similar
            for b in range(a, len(order), step):
                if sizes[b] > most:
                    break
                b2 = min(len(order), b + step)
                apart = labels(a, a2)[:, None] != labels(b, b2)[None, :]
                if not apart.any():  # all are joined already
                    continue
                theirs = code[lanes[b] : lanes[b2]]
                at = np.minimum(np.searchsorted(local, theirs), local.size - 1)
                hit = local[at] == theirs
                right = np.zeros((b2 - b, local.size), np.float32)
                right[owner[lanes[b] : lanes[b2]][hit] - b, at[hit]] = 1
                both = (left @ right.T).astype(np.int64)
                linked = apart & ((100 + similar) * both >= similar * (sizes[a:a2, None] + sizes[None, b:b2]))
                if a == b:
                    linked &= np.arange(a, a2)[:, None] < np.arange(b, b2)[None, :]
                if side is not None:
                    linked &= side[a:a2, None] != side[None, b:b2]
                for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                    i, j = find(a + i), find(b + j)
                    if i != j:
                        root[max(i, j)] = min(i, j)
        out += [(nodes[order[i]], nodes[order[r]]) for i in range(len(order)) if (r := find(i)) != i]
    return out


def set_ids(texts) -> list[int]:
    """set_id of each text of an Arrow array; equal sets have equal ids."""
    flat, sizes = shingle_sets(texts)
    return [set_id(s) for s in np.split(flat, np.cumsum(sizes)[:-1])] if len(texts) else []


def sketch_size(table_bytes: int) -> tuple[int, int]:
    """Bits of a bucket of shingles, and ranges of buckets that a task counts each, for a table of so many bytes.

    Counts take two bytes a shingle or so, three from some 10 GB on, so that a range holds some 100 MB of them in a table of any size up to 100 TB,
    and there a bucket some 60 shingles.
    """
    size = table_bytes.bit_length()
    bits = min(38, max(16, size))
    return bits, 1 << max(4, bits - 23, min(18, size - 29))


def similar_components(docs: DataFrame, similar: int = SIMILAR, heavy: int = HEAVY, most_heavy: int = MOST_HEAVY, block_shingles: int = BLOCK_SHINGLES, labelled_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach from a document, itself included.

    docs: doc_id, text; other columns are ignored.  A null or empty text has no shingle and no link.  Rows
    that repeat a doc_id are documents of their own. A row with a null doc_id takes no part: its component_id
    is null.  Texts of any length are read as a whole; an empty table gives no rows.  It runs jobs, and stages what
    they find.  labelled_sets: also set_id, the id of the row's set, and
    label, which is the same in all rows of a component and in no others (null for the empty set).
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits, n_ranges = sketch_size(int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    per_range = (1 << bits) // n_ranges

    def describe(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row, counted = TaskContext.get().partitionId() << 40, []
        for part in gathered(batches, BATCH_BYTES):
            flat, sizes = shingle_sets(column(part, "text"))
            known = ~np.array(column(part, "doc_id").is_null())
            nodes = [set_id(s) for s in np.split(flat, np.cumsum(sizes)[:-1])]
            counted.append((flat[np.repeat(known, sizes)] >> np.uint64(64 - bits)).astype(np.uint32 if bits <= 32 else np.int64))
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), column(part, "doc_id"), pa.array(sizes), pa.array(nodes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            row += n
            if sum(map(len, counted)) > COUNTED:
                yield from sketch(counted)
        yield from sketch(counted)

    def sketch(counted):
        import pyarrow as pa

        buckets = np.sort(np.concatenate(counted)).astype(np.int64) if counted else np.zeros(0, np.int64)
        counted.clear()
        cuts = np.searchsorted(buckets, np.arange(n_ranges + 1) * per_range)
        rows = [(k, _deltas(buckets[a:b] - k * per_range)) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        for at in range(0, len(rows), 64):
            part, n = rows[at : at + 64], len(rows[at : at + 64])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.array([k for k, _ in part], pa.int32()), pa.array([d for _, d in part], pa.binary())], names=names)

    names = ["row", "doc_id", "n", "node", "range", "counts"]
    found = staged(spark, source.mapInArrow(describe, "row long, doc_id long, n long, node long, range int, counts binary"), "sets")
    rows = found.filter("range is null").select("row", "doc_id", "n", "node")

    def count_heavy(key, batches):
        import pandas as pd

        at, n = heavy_buckets(batches["counts"], per_range, heavy)
        return pd.DataFrame({"bucket": at + int(key[0]) * per_range, "n": n})

    counts = found.filter("range is not null").select("range", "counts").groupBy("range").applyInPandas(count_heavy, "bucket long, n long")
    top = counts.orderBy(F.desc("n"), "bucket").limit(most_heavy).toPandas().sort_values("bucket")
    shipped = spark.sparkContext.broadcast((top["bucket"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))
    small = small_boundary(similar)

    def postings(batches):
        import pyarrow as pa

        buckets, weight = shipped.value
        member = np.zeros(1 << 20, bool)
        member[buckets & 0xFFFFF] = True
        seen: set[int] = set()
        for part in gathered(batches, BATCH_BYTES):
            flat, sizes = shingle_sets(column(part, "text"))
            bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
            load = np.zeros(flat.size, np.int64)
            maybe = np.flatnonzero(member[bucket & 0xFFFFF])
            if buckets.size:
                at = np.minimum(np.searchsorted(buckets, bucket[maybe]), buckets.size - 1)
                load[maybe] = np.where(buckets[at] == bucket[maybe], weight[at], 0)
            keys, nodes, lens, places, loads = [], [], [], [], []
            ends = np.cumsum(sizes).tolist()
            for n, end in zip(sizes.tolist(), ends, strict=True):
                if not n:
                    continue
                s = flat[end - n : end]
                node = set_id(s)
                if node in seen:
                    continue
                seen.add(node)
                if n <= small:
                    own = [hash_of(np.array([c, *sub], np.uint64)) for c in overlap_sizes(n, similar) for sub in combinations(s.tolist(), c)]
                    keys.append(np.array(own, np.int64))
                    places.append(np.zeros(len(own), np.int64))
                    loads.append(np.full(len(own), _SUBSET, np.int64))
                    nodes.append(np.full(len(own), node))
                    lens.append(np.full(len(own), n))
                if 100 * n < similar * (small + 1):
                    continue
                w, p = load[end - n : end], prefix_size(n, similar)
                if w.any():
                    order = np.argsort(w, kind="stable")[:p]
                    s, w = s[order], w[order]
                last, weight_of_last = int(s[p - 1]), int(w[p - 1])
                keys.append(np.array([last >> 2 if not weight_of_last else (1 << 62) + (min(weight_of_last, (1 << 29) - 1) << 32) + (last >> 32)]))
                places.append(np.array([np.count_nonzero(w[:p])]))
                loads.append(np.array([_ABOUT]))
                nodes.append(np.array([node]))
                lens.append(np.array([n]))
                keys.append(s[:p].view(np.int64))
                places.append(np.arange(1, p + 1))
                loads.append((w[:p] > 0).astype(np.int64))
                nodes.append(np.full(p, node))
                lens.append(np.full(p, n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, lens, places, loads)], names=["key", "node", "n", "place", "load"])

    def hash_of(x: np.ndarray) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(x.tobytes(), 7) - (1 << 63)

    known = source.filter("doc_id is not null")
    lists = known.mapInArrow(postings, "key long, node long, n long, place long, load long")
    salts = _SALTS << max(0, bits - 26)  # a list grows with the input, what a task holds of it does not
    salt = F.when(F.col("load") == 0, F.lit(0)).otherwise(F.pmod(F.col("node"), F.lit(salts)))
    inside = Window.partitionBy("key", "salt")
    lists = lists.select("key", "node", F.col("n").cast("int").alias("n"), F.col("place").cast("int").alias("place"), F.col("load").cast("byte").alias("load"), salt.cast("int").alias("salt"))
    met = lists.repartition("key", "salt").withColumns({"low": F.min("node").over(inside), "high": F.max("node").over(inside), "size": F.count("*").over(inside)})
    # lists that are long all the same, beyond the most_heavy, join nobody pair by pair either
    load = F.when((F.col("load") == _LIGHT) & (F.col("size") > heavy), F.lit(_HEAVY)).otherwise(F.col("load"))
    met = staged(spark, met.filter("load <> 0 or low <> high").withColumn("load", load.cast("byte")).drop("high", "size"), "lists")

    stars = met.filter(F.col("load").isin(_SUBSET, _HEAVY))
    heads = staged(spark, stars.groupBy("key").agg(F.min("low").alias("head"), F.max("low").alias("last")).filter("head <> last").drop("last"), "heads")
    across = stars.select("key", "low").distinct().join(heads, "key").select(F.col("low").alias("u"), F.col("head").alias("v"))
    light = staged(spark, met.filter(F.col("load") == _LIGHT).select("key", "node", "n", "place").dropDuplicates(["key", "node"]), "light")
    a, b = light.alias("a"), light.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (100 * F.least("a.n", "b.n") >= similar * F.greatest("a.n", "b.n")))
    pairs = pairs.groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v")).agg(F.count("*").alias("c"), F.max("a.place").alias("i"), F.max("b.place").alias("j"), F.first("a.n").alias("n"), F.first("b.n").alias("m"))

    def may_reach(overlap):
        return (100 + similar) * overlap >= similar * (F.col("n") + F.col("m"))

    # all shared shingles up to the last one met are known, and all light ones up to where the first prefix ends
    pairs = staged(spark, pairs.filter(may_reach(F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")))), "pairs")
    about = met.filter(F.col("load") == _ABOUT).groupBy("node").agg(F.min("key").alias("end"), F.max("place").alias("heavy"))
    about = staged(spark, about, "about")
    pairs = pairs.join(about.select(F.col("node").alias("u"), F.col("end").alias("end_u"), F.col("heavy").alias("heavy_u")), "u")
    pairs = pairs.join(about.select(F.col("node").alias("v"), F.col("end").alias("end_v"), F.col("heavy").alias("heavy_v")), "v")
    beyond = lambda n: F.ceil(F.col(n) * F.lit(similar) / 100) - 1  # noqa: E731  shingles after the prefix
    met_most = F.col("c") + F.least("heavy_u", "heavy_v")
    pairs = pairs.filter(((F.col("end_u") <= F.col("end_v")) & may_reach(met_most + beyond("n"))) | ((F.col("end_v") <= F.col("end_u")) & may_reach(met_most + beyond("m"))))
    candidates = stars.select(F.col("node").alias("u"), F.col("low").alias("v")).unionByName(across).unionByName(pairs.select("u", "v"))
    groups = components(spark, candidates)

    # each component's sets in one cell, or in cells of two blocks each
    one = rows.filter("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    members = staged(spark, groups.join(one, "node").select("node", "doc_id", "n", F.col("label").alias("group")), "members")
    masses = staged(spark, members.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).alias("blocks")), "masses")
    found_in = members.agg(F.sum("n").alias("n"), F.count("*").alias("members")).first()
    bags = max(1, -(-(found_in["n"] or 0) // block_shingles))
    members = members.join(masses, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def cell(other):
        lo, hi = F.least("block", other), F.greatest("block", other)
        own = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(bags))).otherwise(-1 - F.pmod(F.xxhash64("group", lo, hi), F.lit(1 << 50)))
        return F.struct(own.alias("cell"), lo.alias("lo"), hi.alias("hi"))

    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), cell)
    members = staged(spark, members.select("doc_id", "node", "group", "block", cells.alias("cells")), "cells")
    if found_in["members"] <= BROADCAST_ROWS and (members.agg(F.sum(F.size("cells"))).first()[0] or 0) <= BROADCAST_CELLS:
        members = F.broadcast(members)

    def sets_of(batches):
        for part in gathered(batches, BATCH_BYTES):
            flat, sizes = shingle_sets(column(part, "text"))
            out: list[list] = [[] for _ in range(7)]
            held = 0
            rows = zip(*(column(part, c).to_pylist() for c in ("node", "group", "block", "cells")), np.split(flat, np.cumsum(sizes)[:-1]), strict=True)
            for node, group, block, own, s in rows:
                if s.size and set_id(s) == node:
                    raw = s.tobytes()
                    for c in own:
                        for column_of, v in zip(out, (c["cell"], group, c["lo"], c["hi"], block == c["lo"], node, raw), strict=True):
                            column_of.append(v)
                        held += len(raw)
                        if held > BATCH_BYTES:  # a set goes to as many cells as its component has blocks
                            yield from placed_sets(out)
                            out, held = [[] for _ in range(7)], 0
            yield from placed_sets(out)

    def placed_sets(out):
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["cell", "group", "lo", "hi", "first", "node", "shingles"]).to_batches(max_chunksize=2000)

    sets = known.join(members, "doc_id").select("node", "group", "block", "cells", "text").mapInArrow(sets_of, "cell long, group long, lo long, hi long, first boolean, node long, shingles binary")

    def compare(key, part):
        import pandas as pd

        part = part.drop_duplicates(["node", "group", "lo", "hi"])
        groups = []
        for (_, lo, hi), own in part.groupby(["group", "lo", "hi"], sort=False):
            groups.append((own["node"].tolist(), [np.frombuffer(x, np.uint64) for x in own["shingles"]], None if lo == hi else own["first"].tolist()))
        return pd.DataFrame(link_forest(groups, similar), columns=["u", "v"])

    links = sets.groupBy("cell").applyInPandas(compare, "u long, v long")
    joined = components(spark, links)

    labelled = rows.join(joined, "node", "left").select("row", "doc_id", "n", "node", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    least = staged(spark, labelled.filter("label is not null and doc_id is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    out = labelled.join(least, "label", "left")
    more = [F.col("node").alias("set_id"), "label"] if labelled_sets else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *more)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    prepare(spark)
    return similar_components(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), k AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM s
), u AS (
  SELECT k, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k
), x AS (
  SELECT k, n, unnest(s) AS g FROM u
), rare AS (
  SELECT k, n, g, row_number() OVER (PARTITION BY k ORDER BY c, g) AS place FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM x)
), cand AS (
  SELECT DISTINCT a.k AS a, b.k AS b FROM rare a JOIN rare b ON a.g = b.g AND a.k < b.k
  WHERE a.place <= a.n // 5 + 1 AND b.place <= b.n // 5 + 1 AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM (SELECT c.a, c.b, ua.n AS n, ub.n AS m, len(list_intersect(ua.s, ub.s)) AS o FROM cand c JOIN u ua ON ua.k = c.a JOIN u ub ON ub.k = c.b) WHERE 180 * o >= 80 * (n + m)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT k AS a, k AS b FROM u UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least_id AS (
  SELECT k, min(doc_id) AS d FROM k WHERE n > 0 GROUP BY k
), comp AS (
  SELECT r.a AS k, min(l.d) AS component_id FROM reach r JOIN least_id l ON l.k = r.b GROUP BY r.a
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id FROM k LEFT JOIN comp c ON k.n > 0 AND c.k = k.k
"""
