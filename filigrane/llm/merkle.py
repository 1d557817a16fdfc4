"""Merkle manifest of a table: leaves by language, subroots, root, and a proof for every row.

A fragment is a sparse forest: the nodes of a tree, keyed by level and index, whose run of siblings is not
complete.  As the number of leaves tells how many siblings each run has (its arity), two fragments merge in any
grouping: they put their nodes together and replace each complete run by its parent.  A contiguous range of
leaves leaves few such nodes a level, so fragments stay small.  They are reduced as a tree, FAN_IN to one a round,
up to the root; the same rounds walked downwards hand every fragment the siblings that its nodes lack.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.llm.shared import ARROW_ROWS, lean, prepare, remainder, staged, table

ARITY = 2
#: Leaves of a range that one task holds, and fragments that are merged at a time.
PART_ROWS = 1 << 17
LEAST_ROWS = 1 << 12
FAN_IN = 32
#: Characters of a digest.
WIDE = 64
EVERY = 7


def _hash(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def widths(n: int, arity: int = ARITY):
    """Nodes of each level of a tree of n leaves, up to 1."""
    yield n
    while n > 1:
        n = -(-n // arity)
        yield n


def merged(nodes: dict[tuple[int, int], bytes], n: int, arity: int = ARITY) -> tuple[dict, dict]:
    """A forest's nodes with each complete run replaced by its parent, and per replaced node its siblings, in order."""
    left, siblings = dict(nodes), {}
    for level, width in enumerate(widths(n, arity)):
        if width == 1:
            break
        runs: dict[int, list[int]] = {}
        for at, i in sorted(k for k in left if k[0] == level):
            runs.setdefault(i // arity, []).append(i)
        for up, own in runs.items():
            if len(own) == min(arity, width - up * arity):
                digests = [left.pop((level, i)) for i in own]
                for k, i in enumerate(own):
                    siblings[level, i] = b"".join(digests[:k] + digests[k + 1 :])
                left[level + 1, up] = _hash(b"".join(digests))
    return left, siblings


def climbed(digests: list[bytes], start: int, n: int, arity: int = ARITY) -> list[tuple[int, list[bytes], int, int]]:
    """Of leaves start, start + 1, ...: for each level the first node's index, the nodes, and the range of those in complete runs."""
    out, first = [], start
    for width in widths(n, arity):
        end = first + len(digests)
        lo = -(-first // arity) * arity
        hi = end if end == width else end // arity * arity
        if width == 1 or hi <= lo:
            out.append((first, digests, first, first))
            break
        out.append((first, digests, lo, hi))
        digests = [_hash(b"".join(digests[k - first : min(k + arity, hi) - first])) for k in range(lo, hi, arity)]
        first = lo // arity
    return out


def folded(digest: bytes, at: int, n: int, path: bytes, arity: int = ARITY) -> bytes:
    """The root that a node at an index of n and the siblings on its way up give."""
    used = 0
    for width in widths(n, arity):
        if width == 1:
            return digest
        first = at // arity * arity
        size = WIDE * (min(arity, width - first) - 1)
        others, k = path[used : used + size], WIDE * (at - first)
        digest, at, used = _hash(others[:k] + digest + others[k:]), at // arity, used + size
    return digest


def _runs(batches, columns: list[str]):
    """(part, tree), head rows and data rows of each run of a sorted stream of batches."""
    key, heads, rows = None, [], []
    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in ("part", "tree", "kind", *columns)), strict=True):
            if values[:2] != key:
                if rows:
                    yield key, heads, rows
                key, heads, rows = values[:2], [], []
            (rows if values[2] else heads).append(values[3:])
    if rows:
        yield key, heads, rows


def _in_order(placed: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Each part's rows in order, the head rows of each of its trees before the tree's own."""
    every = heads.withColumn("kind", F.lit(0)).unionByName(placed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return every.repartition("part").sortWithinPartitions("part", "tree", "kind", *(F.col(k).asc_nulls_first() for k in keys))


def forest(spark: SparkSession, rows: DataFrame, keys: list[str], arity: int = ARITY, part_rows: int = PART_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees over rows, in order of their keys within each tree.

    rows: tree (string), leaf, keys; the keys tell all rows of a tree apart.  Returns the rows with the part they
    lie in; head rows of each part and tree: its first index (start), the tree's leaves (total) and, a row each,
    the siblings (path) from a node (level, at) of that part to the tree's root; and tree, root, total.
    """
    n = rows.count()
    parts = max(1, -(-n // part_rows), min(spark.sparkContext.defaultParallelism, -(-n // min(part_rows, LEAST_ROWS))))
    placed = rows.repartitionByRange(parts, "tree", *(F.col(k).asc_nulls_first() for k in keys)).withColumn("part", F.spark_partition_id())
    placed = staged(spark, placed, "placed")
    of_tree = Window.partitionBy("tree")  # a row for each part that holds some of the tree
    runs = placed.groupBy("part", "tree").agg(F.count("*").alias("m")).withColumns({
        "total": F.sum("m").over(of_tree), "start": F.sum("m").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
    })
    runs = staged(spark, runs.select("part", "tree", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("total").cast("long").alias("total")), "runs")

    def grow(batches):
        import pyarrow as pa

        names = ["tree", "part", "total", "level", "at", "digest"]
        for (part, tree), heads, own in _runs(batches, ["start", "total", "leaf"]):
            start, total = heads[0][:2]
            out = []
            for level, (first, digests, lo, hi) in enumerate(climbed([r[2].encode() for r in own], start, total, arity)):
                out += [(tree, part, total, level, i, digests[i - first].decode()) for i in (*range(first, lo), *range(max(hi, lo), first + len(digests)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=names)
        lean()

    shape = "tree string, part int, total long, level int, at long, digest string"
    nodes = staged(spark, _in_order(placed, runs, keys).mapInArrow(grow, shape), "nodes")

    def known(rows) -> dict:
        return {(level, at): digest.encode() for level, at, digest in zip(rows["level"].tolist(), rows["at"].tolist(), rows["digest"], strict=True)}

    def reduce(key, rows):
        import pandas as pd

        n = int(rows["total"].iloc[0])
        left, _ = merged(known(rows), n, arity)
        return pd.DataFrame([(key[0], key[1], n, level, at, d.decode()) for (level, at), d in left.items()], columns=["tree", "part", "total", "level", "at", "digest"])

    # the root is the node of the level that has one only: so many levels up that arity**level reaches the leaves
    levels = next(k for k, w in enumerate(widths(max(1, n), arity)) if w == 1)
    is_root = F.col("level") == sum((F.when(F.col("total") > arity**k, 1).otherwise(0) for k in range(levels)), F.lit(0))
    rounds, roots = [nodes], nodes.filter(is_root)
    while True:
        below = rounds[-1].filter(~is_root)
        if below.isEmpty():
            break
        up = staged(spark, below.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("tree", "part").applyInPandas(reduce, shape), "nodes")
        roots = roots.unionByName(up.filter(is_root))
        rounds.append(up)

    def descend(key, rows, above):
        import pandas as pd

        found = {(level, at): path for level, at, path in zip(above["level"].tolist(), above["at"].tolist(), above["path"], strict=True)}
        left, siblings = merged(known(rows), int(rows["total"].iloc[0]), arity) if len(rows) else ({}, {})

        def path(node):
            out = b""
            while node in siblings:
                out += siblings[node]
                node = node[0] + 1, node[1] // arity
            return out.decode() + found.get(node, "")

        out = [(key[0], part, level, at, path((level, at))) for part, level, at in zip(rows["own"].tolist(), rows["level"].tolist(), rows["at"].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["tree", "part", "level", "at", "path"])

    paths = rounds[-1].select("tree", "part", "level", "at", F.lit("").alias("path"))  # roots only
    for below in reversed(rounds[:-1]):
        grouped = below.filter(~is_root).withColumn("own", F.col("part")).withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("tree", "part")
        down = grouped.cogroup(paths.groupBy("tree", "part")).applyInPandas(descend, "tree string, part int, level int, at long, path string")
        paths = staged(spark, down.unionByName(below.filter(is_root).select("tree", "part", "level", "at", F.lit("").alias("path"))), "paths")
    heads = runs.join(paths, ["tree", "part"])
    return placed, heads, roots.select("tree", F.col("digest").alias("root"), "total")


def _paths(heads: list[tuple], own: list[tuple], leaf_at: int, arity: int):
    """Index and path to the tree's root of each row of a run; heads: (start, total, level, at, path), a row each."""
    start, total = heads[0][:2]
    beyond = {(h[2], h[3]): h[4].encode() for h in heads}
    levels = climbed([r[leaf_at].encode() for r in own], start, total, arity)
    counts = list(widths(total, arity))
    for i in range(start, start + len(own)):
        at, out = i, b""
        for level, (first, digests, lo, hi) in enumerate(levels):
            if not lo <= at < hi:
                break
            run = at // arity * arity
            out += b"".join(digests[k - first] for k in range(run, min(run + arity, counts[level])) if k != at)
            at //= arity
        yield i, out + beyond[level, at]


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, part_rows: int = PART_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    docs: doc_id, source, lang, n_chars, text; other columns, whatever their names, are ignored.  A leaf hashes these
    five, a null as `-`, so that null and empty differ.  A null lang is a group of its own, before all others.  In a
    group rows stand by doc_id (null first), those that share one by their leaves, and equal rows in any order: each
    has a place and a proof of its own.  Texts are hashed as a whole, of any length.  A table of one row has its leaf as root and
    the hash of nothing as proof; an empty table gives no rows.  tampered: for which rows the leaf that the proof is
    tried on is made with n_chars + 1 (null: not).  Runs jobs, and stages what they find.
    """
    spark = docs.sparkSession

    def leaf(n_chars: Column) -> Column:
        said = [F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), n_chars.cast("string"), F.col("text").cast("string")]
        return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)).cast("binary"), 256)

    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")
    other = F.when(tampered if tampered is not None else F.lit(False), leaf(more.cast("decimal(20,0)")))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars").cast("long")).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = staged(spark, leaves, "leaves")
    keys = ["doc_id", "leaf", "row"]
    placed, heads, roots = forest(spark, leaves, keys, arity, part_rows, fan_in)
    roots = staged(spark, roots, "roots")

    # the subroots are the leaves of one more tree
    above, above_heads, root = forest(spark, roots.select(F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("of")), ["of"], arity, part_rows, fan_in)

    def place(batches):
        import pyarrow as pa

        for _, tops, own in _runs(batches, ["start", "total", "level", "at", "path", "leaf", "of", "root"]):
            found = [(r[6], r[5], tops[0][7], i, tops[0][1], path.decode()) for r, (i, path) in zip(own, _paths(tops, own, 5, arity), strict=True)]
            for k in range(0, len(found), ARROW_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + ARROW_ROWS]), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["tree", "subroot", "root", "top_at", "top_total", "top_path"])

    tops = _in_order(above, above_heads.join(root.select("tree", "root"), "tree"), ["of"]).mapInArrow(place, "tree string, subroot string, root string, top_at long, top_total long, top_path string")
    heads = heads.join(staged(spark, tops, "tops"), "tree")
    shown = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(batches):
        import pyarrow as pa

        for _, heads, own in _runs(batches, ["start", "total", "level", "at", "path", "subroot", "root", "top_at", "top_total", "top_path", "doc_id", "leaf", "other"]):
            total, (subroot, root, top_at, top_total, top_path) = heads[0][1], heads[0][5:10]
            up, out = top_path.encode(), []
            for r, (i, path) in zip(own, _paths(heads, own, 11, arity), strict=True):
                doc, leaf, other = r[10:]
                got = folded(folded((other or leaf).encode(), i, total, path, arity), top_at, top_total, up, arity).decode()
                out.append((doc, leaf, subroot, root, sha256(path + up).hexdigest(), got, got == root))
                if len(out) == ARROW_ROWS:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
        lean()

    def batch(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names=shown)

    return _in_order(placed, heads, keys).mapInArrow(prove, kinds)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every row whose hashed doc_id 7 divides is tried with one character more."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, remainder(F.col("doc_id"), EVERY) == 0)


def _field(name: str) -> str:
    said = f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({said}) || ':' || {said}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: CRC-32 of a decimal number: a byte is put in, or (-1) a bit shifted out.
_CRC = """(4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), CAST([-1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[]))))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs: all nodes of the trees over leaves (tree, pos, digest), and per node the sibling, if any."""
    return f"""{name}_n AS (
  SELECT tree, 0 AS level, pos, digest, count(*) OVER (PARTITION BY tree) AS width FROM {leaves}
  UNION ALL
  SELECT tree, level, pos, digest, count(*) OVER (PARTITION BY tree) AS width FROM (
    SELECT tree, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}_n WHERE width > 1 GROUP BY tree, level, pos // 2)
), {name}_s AS (
  SELECT a.tree, a.level, a.pos, b.digest AS sibling, a.width FROM {name}_n a LEFT JOIN {name}_n b ON a.tree = b.tree AND a.level = b.level AND b.pos = xor(a.pos, 1)
)"""


def _way_sql(name: str, start: str, siblings: str) -> str:
    """CTE: the siblings and the folded digest on the way up, from start (r, tree, pos, digest)."""
    return f"""{name} AS (
  SELECT r, tree, 0 AS level, pos, digest, '' AS path FROM {start}
  UNION ALL
  SELECT w.r, w.tree, w.level + 1, w.pos // 2, sha256(CASE WHEN s.sibling IS NULL THEN w.digest WHEN w.pos % 2 = 0 THEN w.digest || s.sibling ELSE s.sibling || w.digest END), w.path || coalesce(s.sibling, '')
  FROM {name} w JOIN {siblings} s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos WHERE s.width > 1
)"""


OP13_SQL = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS tried FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM l
), leaves AS (
  SELECT tree, pos, leaf AS digest FROM p
), {_tree_sql('low', 'leaves')}, subroots AS (
  SELECT '' AS tree, tree AS own, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low_n WHERE width = 1
), {_tree_sql('high', 'subroots')}, tried AS (
  SELECT r, tree, pos, tried AS digest FROM p
), {_way_sql('up', 'tried', 'low_s')}, reached AS (
  SELECT u.r, '' AS tree, s.pos, u.digest, u.path, s.digest AS subroot FROM up u JOIN low_n t ON t.tree = u.tree AND t.level = u.level AND t.pos = u.pos AND t.width = 1 JOIN subroots s ON s.own = u.tree
), {_way_sql('on_top', 'reached', 'high_s')}
SELECT p.doc_id, p.leaf, e.subroot, h.digest AS root, sha256(e.path || o.path) AS proof_sha256, o.digest AS folded_root, o.digest = h.digest AS verified
FROM p JOIN reached e ON e.r = p.r JOIN on_top o ON o.r = p.r JOIN high_n h ON h.level = o.level AND h.pos = o.pos AND h.width = 1
"""
