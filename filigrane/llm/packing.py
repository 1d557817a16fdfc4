"""Best-fit packing by hierarchical residual packing.

Each partition tokenizes its texts, cuts long ones and packs the pieces best-fit, longest first.  Bins that
stay underfull become items: groups of partitions merge them best-fit, then groups of groups, up to one root.
After a best-fit pass at most one bin of a group is half empty or more, and two fuller bins can't be merged;
so a group passes up that bin and, as its possible partners in other groups, as many of its emptiest bins as
a node has children.  The rest can only stay as they are.  What a node sees is thus bounded, and rows are kept
whole.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.bpe import VOCABULARY, char_tables, encoder
from filigrane.llm.shared import column, gathered, prepare, staged, table

CAPACITY = 2048
#: Children of a node of the merge tree.
FAN = 64
#: A bin at least this full is final.
NEARLY_FULL = 0.995
#: Pieces that are packed together locally.
LOCAL_PIECES = 400_000
#: Bits of a bin's number within its partition.
_BIN_BITS = 40
#: Bytes of texts that are encoded together.
_BYTES = 6_000_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the tightest bin that holds it, and each bin's fill."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    where, offset = [0] * len(sizes), [0] * len(sizes)
    order, left = np.argsort(-sizes, kind="stable").tolist(), sizes.tolist()
    rest: list[int] = []
    for i in order:
        s = left[i]
        if m := mask >> s:
            r = s + (m & -m).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            b, r = bins, capacity
            bins += 1
            rest.append(capacity)
        where[i], offset[i] = b, capacity - r
        r -= s
        rest[b] = r
        if r:
            free[r].append(b)
            mask |= 1 << r
    return np.array(where, np.int64), np.array(offset, np.int64), capacity - np.array(rest, np.int64)


def passed_up(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins of a group may still be merged with those of others."""
    out = np.zeros(len(fill), bool)
    out[np.argsort(fill, kind="stable")[: FAN + 1]] = True
    return out & (fill < NEARLY_FULL * capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, fan: int = FAN, local_pieces: int = LOCAL_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A document is its
    text's ids and one id 0 at the end, so a null or empty text is a piece of length 1.  Documents longer
    than capacity are cut at its multiples, others are whole.  Repeated rows and null doc_ids are documents
    of their own; other columns are ignored; an empty table gives no rows.  It runs a job to pack locally.
    """
    spark, tables = docs.sparkSession, char_tables(vocabulary)

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, bins = encoder(vocabulary, tables), TaskContext.get().partitionId() << _BIN_BITS
        held: list[list] = [[], [], [], [], []]  # arrays of what a batch of texts gave

        def flush():
            nonlocal bins
            doc_id, piece, start, length, crc = (pa.concat_arrays(c) for c in held)
            for c in held:
                c.clear()
            where, offset, fill = best_fit(length.to_numpy(), capacity)
            up = passed_up(fill, capacity)
            arrays = [doc_id, piece, start, length, crc, pa.array(where + bins), pa.array(offset), pa.array(fill[where]), pa.array(up[where])]
            bins += len(fill)
            yield from pa.table(arrays, names=names).to_batches(max_chunksize=10_000)

        for part in gathered(batches, _BYTES):
            cuts: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(column(part, "doc_id").to_pylist(), enc.encode_all(column(part, "text")), strict=True):
                data = memoryview(np.append(ids, 0).astype("<u4").tobytes())
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    for c, x in zip(cuts, (doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        c.append(x)
            for c, x, k in zip(held, cuts, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True):
                c.append(pa.array(x, k))
            if sum(map(len, held[0])) >= local_pieces:
                yield from flush()
        if held[0]:
            yield from flush()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "up"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, up boolean"
    pieces = staged(spark, source.mapInArrow(local, schema), "pieces")

    def merge(key, rows):
        roots = rows.drop_duplicates("root").reset_index(drop=True)
        where, offset, fill = best_fit(roots["fill"].to_numpy(), capacity)
        up = passed_up(fill, capacity)
        first = np.zeros(len(fill), np.int64)
        first[where[::-1]] = roots["root"].to_numpy()[::-1]
        at = roots.index[np.searchsorted(roots["root"].to_numpy(), rows["root"].to_numpy(), sorter=np.argsort(roots["root"].to_numpy()))]
        at = np.argsort(roots["root"].to_numpy())[at]
        return rows.assign(root=first[where[at]], base=rows["base"].to_numpy() + offset[at], fill=fill[where[at]], up=up[where[at]])

    rows = pieces.filter("up").groupBy("bin").agg(F.max("fill").alias("fill")).select(F.col("bin").alias("root"), "fill", "bin", F.lit(0).cast("long").alias("base"), F.lit(True).alias("up"))
    most = pieces.agg(F.max(F.shiftright("bin", _BIN_BITS)).alias("m")).first()["m"]
    done, width = None, 1
    while True:
        width *= fan
        node = F.floor(F.shiftright("root", _BIN_BITS) / F.lit(width)).alias("node")
        out = rows.select(node, "root", "fill", "bin", "base", "up").groupBy("node").applyInPandas(merge, "node long, root long, fill long, bin long, base long, up boolean")
        last = most is None or most < width
        out = (out if last and done is None else staged(spark, out, "bins")).drop("node")
        closed = out if last else out.filter("not up")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        rows = out.filter("up")
    moved = done.select("bin", "root", "base")
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"))
