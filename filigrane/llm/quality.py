"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted for whole texts, a batch at a time, in numpy.  The trees are grown level by level on
binned statistics and kept as flat arrays of complete binary trees, so that scoring is a few array reads a
level for all documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.shared import annotated, hash_below, prepare, remainder, table

#: Labelled rows to learn from, about: rows are taken by a hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Bytes of text that are counted at a time.
SLICE_BYTES = 1_000_000
#: Score from which a document is predicted to be good.
THRESHOLD = 0.7
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "doubled_words", "distinct_pairs", "top_pair",
    "upper", "lower", "digits", "spaces", "lines", "stops", "symbols", "bars", "quotes", "controls", "beyond_ascii", "line_bytes",
)
_CLASSES = 10


def _byte_classes() -> np.ndarray:
    out = np.full(256, 6, np.int64)  # symbols
    for kind, members in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), b".,;:?-")):
        out[list(members)] = kind
    out[ord("|")] = 7
    out[list(b"'\"()")] = 8
    out[[*range(9), 11, 12, *range(14, 32), 127]] = 9
    out[128:] = 1  # letters beyond ASCII count with the small ones, and apart from that in beyond_ascii
    return out


def statistics(texts) -> np.ndarray:
    """A row of STATISTICS for each text of an Arrow array; a null text counts as empty.

    Texts are counted in slices of SLICE_BYTES, which bounds the memory; a longer text goes alone.
    """
    import pyarrow.compute as pc

    upto, at, out = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0, []
    while at < len(texts):
        n = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")) - at)
        out.append(_counted(texts.slice(at, n)))
        at += n
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def _counted(texts) -> np.ndarray:
    import pyarrow.compute as pc

    n = len(texts)
    texts = pc.fill_null(texts, "")
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]).astype(np.int64)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : first + bounds[-1]]
    by_byte = np.zeros((n, 256), np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for k in range(a, b, SLICE_BYTES):
            by_byte[i] += np.bincount(raw[k : min(b, k + SLICE_BYTES)], minlength=256)
    by_class = by_byte @ (_byte_classes()[:, None] == np.arange(_CLASSES)).astype(np.int64)
    high = by_byte[:, 128:].sum(1)
    size = np.maximum(1, np.diff(bounds))
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    code, ends = words.indices.to_numpy(), split.offsets.to_numpy() - (split.offsets[0].as_py() if n else 0)
    word_size = pc.binary_length(words.dictionary).to_numpy() if len(words.dictionary) else np.zeros(0, np.int32)
    real = word_size[code] > 0
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))[real]
    code = code[real].astype(np.int64)
    n_words = np.bincount(owner, minlength=n)
    least = np.maximum(1, n_words)

    def variety(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many different keys a document has, and how often its commonest one occurs."""
        order = np.lexsort((keys, own)) if keys.size else np.zeros(0, np.int64)
        k, o = keys[order], own[order]
        new = np.ones(k.size, bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        runs = np.diff(np.append(np.flatnonzero(new), k.size))
        most = np.zeros(n)
        np.maximum.at(most, o[new], runs)
        return np.bincount(o[new], minlength=n), most

    distinct, top = variety(code, owner)
    same = owner[1:] == owner[:-1]
    pairs, most_pair = variety((code[:-1] * (len(words.dictionary) + 1) + code[1:])[same], owner[1:][same])
    doubled = np.bincount(owner[1:][same & (code[1:] == code[:-1])], minlength=n)
    n_lines = by_class[:, 4] + 1
    columns = [
        np.log1p(np.diff(bounds)), np.log1p(n_words), (size - by_class[:, 3] - by_class[:, 4]) / least, distinct / least, top / least, doubled / least,
        pairs / np.maximum(1, n_words - 1), most_pair / np.maximum(1, n_words - 1),
        *(by_class[:, k] / size for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)), high / size, np.log1p(size / n_lines),
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2; a node that isn't split sends all left."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        every, depth = np.arange(len(rows)), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 20, ridge: float = 1.0) -> Trees:
    """Fit by logistic loss. Without rows the score is 0.5, with one class its smoothed share."""
    n, width = rows.shape
    share = (labels.sum() + 1) / (n + 2)
    out = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), float(np.log(share / (1 - share))))
    if n == 0 or labels.min() == labels.max():
        return out
    edges = [np.unique(np.quantile(rows[:, j], np.arange(1, bins) / bins)) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(edges)])
    flat = binned + np.arange(width) * bins
    total = np.full(n, out.start)
    kept: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = labels - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, nodes = 2**level - 1, 2**level
            slot = ((node - base)[:, None] * (width * bins) + flat).ravel()
            g, h, c = (np.bincount(slot, np.repeat(w, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for w in (grad, hess, np.ones(n)))
            ga, ha, ca = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (ga - g) ** 2 / (ha - h + ridge) - ga**2 / (ha + ridge)
            gain[(c < least) | (ca - c < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, at = divmod(b, bins)
                if gain[k, j, at] > 1e-9 and at < len(edges[j]):
                    feature[base + k], threshold[base + k] = j, edges[j][at]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > threshold[node])
        end = node - (2**depth - 1)
        leaf = rate * np.bincount(end, grad, 2**depth) / (np.bincount(end, hess, 2**depth) + ridge)
        total += leaf[end]
        kept.append((feature, threshold, leaf))
    out.feature, out.threshold, out.leaf = (np.array([k[i] for k in kept]) for i in range(3))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learn labels.quality from whole texts of labelled documents that aren't held out (crc32(doc_id) mod 4 = 2).

    About sample_rows of them, chosen by a hash of doc_id, come to the driver as statistics (20 numbers a
    row), 4 times as many at most where ids repeat.  Null ids, labels or texts without a label aren't learned
    from; each repeated label counts.
    """
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(F.col("quality").isin(0.0, 1.0) & (remainder(F.col("doc_id"), 4) != 2))
    learn = learn.filter(F.xxhash64("doc_id") <= hash_below(sample_rows, learn.count()))
    asked = F.broadcast(learn.select("doc_id").distinct())  # about sample_rows numbers at most, however many labels there are
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id", "left_semi")
    rows = annotated(source, lambda: lambda texts: list(map(_as_array, statistics(texts).T)), ", ".join(f"{c} double" for c in STATISTICS), ["doc_id"], 2_000_000)
    got = rows.join(learn, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS, "quality").limit(4 * sample_rows).toPandas()
    return grow(got[list(STATISTICS)].to_numpy(float), got["quality"].to_numpy(float))


def _as_array(values):
    import pyarrow as pa

    return pa.array(np.ascontiguousarray(values))


def scored(docs: DataFrame, trees: Trees, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with a score from 0 to 1 for every whole text; an empty or null text is scored like any other.

    Texts of any length are read as a whole; equal texts have equal scores, so rows that repeat do; a column of docs
    that has the score's name gives way, all others stay as they are; an empty table has no rows.
    """
    return annotated(docs, lambda: lambda texts: [_as_array(trees.score(statistics(texts)))], f"{column} double", keep)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; a null doc_id isn't held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
