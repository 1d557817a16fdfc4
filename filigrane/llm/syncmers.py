"""Document fingerprints from closed syncmers, by DataFrame functions only.

A k-mer is K words; its inner substrings are the pairs of neighbouring words in it.  It is chosen if the pair
with the smallest hash is its first or last one, which depends on the k-mer alone: the same passage gives the
same anchors in any text, at positions that can be matched.  A fingerprint is the SKETCH smallest hashes of a
text's anchors; the likeness of two is the share of the smallest hashes of both together that both hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.llm.shared import prepare, staged, table

#: Words of a k-mer; the choice below reads its four word pairs.
K = 5
#: Hashes of a fingerprint.
SKETCH = 64
_SPACE = "[ \\t-\\r]+"
#: Bits of doc_id within a group, and between the levels of groups.
_LOW, _STEP, _LEVELS = 8, 12, 5


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint> out: at each word where a closed syncmer begins its hash, else null."""
    words, hashes, pairs = f"__w_{out}", f"__h_{out}", f"__m_{out}"
    df = df.withColumn(words, F.array_remove(F.split(F.col(text), _SPACE), ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    rest = F.greatest(F.size(hashes) - 1, F.lit(0))
    df = df.withColumn(pairs, F.zip_with(F.slice(hashes, F.lit(1), rest), F.slice(hashes, F.lit(2), rest), lambda a, b: F.xxhash64(a, b)))

    def choose(x: Column, i: Column) -> Column:
        inner = [F.get(pairs, i + j) for j in range(1, 4)]
        edge = F.least(x, inner[2]) <= F.least(inner[0], inner[1])
        return F.when((i + 3 < F.size(pairs)) & edge, F.xxhash64(x, inner[1], inner[2]).bitwiseAND(F.lit(0xFFFFFFFF)))

    return df.withColumn(out, F.transform(pairs, choose)).withColumn(f"__whole_{out}", F.when(F.size(words) > 0, F.array(F.xxhash64(words).bitwiseAND(F.lit(0xFFFFFFFF))))).drop(words, hashes, pairs)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint> out: the fingerprint of column text.

    A text without words has none (an empty array); one in which no k-mer is chosen, so any of fewer than K
    words, has the hash of its word sequence.
    """
    df = with_anchors(df, text, out)
    chosen = f"__c_{out}"
    df = df.withColumn(chosen, F.slice(F.sort_array(F.array_distinct(F.array_compact(out))), 1, SKETCH))
    return df.withColumn(out, F.when(F.size(chosen) > 0, F.col(chosen)).otherwise(F.coalesce(f"__whole_{out}", F.array().cast("array<bigint>")))).drop(chosen, f"__whole_{out}")


def as_text(fingerprint: str) -> Column:
    """Eight hex digits a hash, in ascending order."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1; 1 for two empty fingerprints, 0 if only one is empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)).cast("double"))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the first word, from 0), anchor: every closed syncmer of every whole text."""
    found = with_anchors(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "a")
    return found.select("doc_id", F.posexplode("a").alias("position", "anchor")).filter(F.col("anchor").isNotNull())


def _next_firsts(groups: DataFrame, level: int) -> DataFrame:
    """groups: b, f, a row a group with its smallest id. Returns b, nxt: the next group's f, the first's after the last.

    Each level orders at most 2**_STEP groups in one task; the level below the top 2**(_STEP - 4), the top 2**12.
    """
    if level == _LEVELS:
        order = Window.orderBy("b")
        everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return groups.select("b", F.coalesce(F.lead("f").over(order), F.first("f").over(everything)).alias("nxt"))
    placed = groups.withColumn("g", F.shiftright("b", _STEP if level < _LEVELS - 1 else _STEP - 4))
    inside = placed.withColumn("nxt", F.lead("f").over(Window.partitionBy("g").orderBy("b")))
    above = _next_firsts(placed.groupBy("g").agg(F.min("f").alias("f")).withColumnRenamed("g", "b"), level + 1)
    return inside.join(above.select(F.col("b").alias("g"), F.col("nxt").alias("after")), "g").select("b", F.coalesce("nxt", "after").alias("nxt"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document's
    by ascending doc_id, the first's after the last.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  A null text is empty.  Rows of one doc_id follow each other
    by text, equal rows in any order; equal hashes in a text count once.  A null doc_id has no place in the order: its
    edited text is its first half, near_next 0.  Other columns, whatever their names, are ignored; texts of any length
    are read as a whole; an empty table gives no rows.

    Documents meet their successors in groups of 2**8 ids; the first document of the next group is copied into each.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = base.filter(F.col("doc_id").isNotNull()).withColumn("b", F.shiftright("doc_id", _LOW))
    groups = known.groupBy("b").agg(F.min("doc_id").alias("f"))
    nexts = staged(spark, _next_firsts(staged(spark, groups, "groups"), 1).select(F.col("b").alias("own"), F.col("nxt").alias("doc_id")), "nexts")
    copies = known.drop("b").join(nexts, "doc_id").select("doc_id", "text", F.col("own").alias("b"), F.lit(True).alias("copy"))
    rows = known.withColumn("copy", F.lit(False)).unionByName(copies).repartition("b")
    rows = with_fingerprint(rows, "text", "fp")
    order = Window.partitionBy("b").orderBy("copy", "doc_id", "text")
    rows = rows.withColumns({"next": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).filter(~F.col("copy"))
    alone = with_fingerprint(base.filter(F.col("doc_id").isNull()), "text", "fp").withColumns({"next": F.lit(""), "next_fp": F.lit(None).cast("array<bigint>")})
    rows = rows.select("doc_id", "text", "fp", "next", "next_fp").unionByName(alone)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))).drop("text", "next")
    rows = with_fingerprint(rows, "edited", "efp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), F.when(F.col("next_fp").isNotNull(), likeness("fp", "next_fp")).otherwise(0.0).alias("near_next"),
    )


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    prepare(spark)
    return edited_fingerprints(table(spark, sf_dir, "documents"))
