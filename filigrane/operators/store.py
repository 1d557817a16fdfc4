"""A search index that is kept: parents, chunks with their vectors, postings and files, written batch by batch.

    path/delta/batch=7/{parents,chunks,postings,files}   what batch 7 brought
    path/base=3/{parents,chunks,postings,files}          batches folded together
    path/manifest/3                                      "3 7": base 3 holds all batches up to 7

A batch is written under its number, so that writing it again changes nothing.  A file that comes again replaces
what earlier batches hold of it: files names the last batch of each source, and older rows are dead.  compact()
folds the live rows into a new base and only then names it, in a manifest that is made once.  Postings are laid
out by a bucket of their term, which a search prunes by.  A chunk's terms are counted in its row, and each task writes
a file a bucket, so that postings are not shuffled; nor are live rows, unless very many files came again.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.operators import bm25, chunking, fusion, vector
from filigrane.session import repeats, shared_path, small, write_by

TERM_BUCKETS = 32
PLACE = ("source", "parent_idx", "child_idx")
SHAPES = {
    "parents": "source string, section string, parent_idx int, content string",
    "chunks": "source string, parent_idx int, child_idx int, section string, len int, embedding array<double>, boost double",
    "postings": "source string, parent_idx int, child_idx int, term string, tf long, len int, section string, bucket int",
    "files": "source string",
}


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def entries(docs: DataFrame) -> dict[str, DataFrame]:
    """parents, chunks, postings and files of docs (source, section, content). A source is one text; a blank one has a file only.

    It runs a job: of sources that come twice, the postings of equal places are added up.
    """
    docs = docs.filter("source is not null").select(F.col("source").cast("string").alias("source"), "section", "content")
    parents = chunking.parents(docs, F.col("source"), F.col("content"), F.col("section")).select("source", "section", "parent_idx", "content")
    of_parent = parents.withColumn("parent_id", F.lit(""))
    pieces = chunking.children(of_parent).select(F.struct(*PLACE).alias("at"), "section", "content")
    tokens = T.tokens(F.coalesce(F.col("content"), F.lit("")))
    vectors = vector.embedded(pieces.withColumns({"of": F.struct("at", "section", F.size(tokens).alias("len"))}), "of", "content")
    chunks = vectors.select("of.at.*", "of.section", "of.len", "embedding", "boost")
    words = pieces.select("at", "section", tokens.alias("tokens")).select("at.*", F.explode(T.counts(F.col("tokens"))).alias("t"), F.size("tokens").alias("len"), "section")
    postings = words.select(*PLACE, "t.term", "t.tf", "len", "section")
    if repeats(docs, "source"):
        postings = postings.groupBy(*PLACE, "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"), F.first("section").alias("section"))
    postings = postings.withColumn("bucket", term_bucket(F.col("term")))
    return {"parents": parents, "chunks": chunks, "postings": postings, "files": docs.select("source").distinct()}


@dataclass
class Store:
    """The index under a path."""

    spark: SparkSession
    path: str
    dead: tuple = field(default=(), compare=False, repr=False)

    def _fs(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def current(self) -> tuple[int, int]:
        """The base in force (0: none) and the last batch that it holds (-1: none)."""
        last = max((int(n) for n in self._names("manifest") if n.isdigit()), default=0)
        if not last:
            return 0, -1
        return tuple(map(int, self.spark.read.text(f"{self.path}/manifest/{last}").first()[0].split()))

    def add(self, docs: DataFrame, batch: int) -> None:
        """Write a batch (source, section, content); one that a base holds already, or that is whole, stays as it is."""
        if batch <= self.current()[1] or "_SUCCESS" in self._names(f"delta/batch={batch}/files"):
            return
        for kind, rows in entries(docs).items():  # files last: a batch without them is not there yet
            self._write(rows, f"delta/batch={batch}", kind)

    def _write(self, rows: DataFrame, folder: str, kind: str) -> None:
        if kind == "postings":
            write_by(rows, "bucket", TERM_BUCKETS, f"{self.path}/{folder}/{kind}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}/{kind}")

    def _batches(self) -> list[tuple[int, str]]:
        base, upto = self.current()
        deltas = sorted(int(n.split("=")[1]) for n in self._names("delta"))
        found = [(b, f"delta/batch={b}") for b in deltas if b > upto and "_SUCCESS" in self._names(f"delta/batch={b}/files")]
        return ([(upto, f"base={base}")] if base else []) + found

    def _all(self, kind: str) -> DataFrame | None:
        every = None
        for batch, folder in self._batches():  # compact() keeps them few
            rows = self.spark.read.schema(SHAPES[kind]).parquet(f"{self.path}/{folder}/{kind}").withColumn("batch", F.lit(batch).cast("long"))
            every = rows if every is None else every.unionByName(rows)
        return every

    def read(self, kind: str) -> DataFrame:
        """The live rows of a kind: of each source those of its last batch."""
        rows = self._all(kind)
        if rows is None:
            raise ValueError(f"no batch has been added under {self.path}")
        if len(self._batches()) == 1:
            return rows.drop("batch")
        return rows.join(self._dead(), ["source", "batch"], "left_anti").drop("batch")

    def _dead(self) -> DataFrame:
        """source, batch of files that a later batch replaces; kept until another batch comes."""
        batches = self._batches()
        if not self.dead or self.dead[0] != batches:
            files = self._all("files")
            last = files.groupBy("source").agg(F.max("batch").alias("last"), F.min("batch").alias("first")).filter("first < last").select("source", "last")
            where = shared_path(self.spark, "dead")
            files.join(last, "source").filter("batch < last").select("source", "batch").write.parquet(where)
            self.dead = (batches, small(self.spark.read.schema("source string, batch long").parquet(where)))
        return self.dead[1]

    def compact(self) -> None:
        """Fold all batches into a new base. What is no longer needed stays until clean(), as a reader may be at it."""
        base, upto = self.current()
        batches = self._batches()
        if not batches or batches == [(upto, f"base={base}")]:
            return
        for kind in SHAPES:
            self._write(self.read(kind), f"base={base + 1}", kind)
        fs, where = self._fs(f"{self.path}/manifest/{base + 1}")
        fs.mkdirs(where.getParent())
        partial = self._fs(f"{self.path}/manifest/.{base + 1}.partial")[1]
        out = fs.create(partial, True)
        out.write(f"{base + 1} {batches[-1][0]}".encode())
        out.close()
        if not fs.rename(partial, where):
            raise ValueError(f"base {base + 1} is there already: another compaction ran")

    def clean(self) -> None:
        """Remove bases and batches that the base in force replaces."""
        base, upto = self.current()
        old = [f"base={n.split('=')[1]}" for n in self._names(".") if n.startswith("base=") and int(n.split("=")[1]) < base]
        old += [f"delta/{n}" for n in self._names("delta") if int(n.split("=")[1]) <= upto]
        for folder in old:
            fs, where = self._fs(f"{self.path}/{folder}")
            fs.delete(where, True)

    def statistics(self) -> DataFrame:
        """One row: n, avgdl over the live chunks."""
        return self.read("chunks").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))

    def terms(self, *asked: str) -> DataFrame:
        """Live postings of some terms; only their buckets are read."""
        buckets = sorted({zlib.crc32(t.encode()) % TERM_BUCKETS for t in asked})
        return self.read("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(asked)))

    def words(self, query: str, k: int, section: str | None = None) -> DataFrame:
        """source, parent_idx, child_idx, score, rank by BM25, as bm25.search gives it: chunks that match nothing score 0."""
        times = {t: query.lower().split().count(t) for t in dict.fromkeys(query.lower().split())}
        kept = bm25.section_kept(F.col("section"), section)
        postings = self.terms(*times)
        df = postings.groupBy("term").agg(F.count("*").alias("df"))  # a row a term of the query
        weight = F.lit(0)
        for t, n in times.items():
            weight = F.when(F.col("term") == t, n).otherwise(weight)
        hits = postings.filter(kept).join(F.broadcast(df), "term").crossJoin(F.broadcast(self.statistics()))
        part = bm25.term_score(weight.cast("double") * bm25.idf(F.col("n"), F.col("df")), F.col("tf").cast("double"), F.col("len"), F.col("avgdl"))
        found = hits.groupBy(*PLACE).agg(F.sum(part).alias("score"))
        none = self.read("chunks").filter(kept).select(*PLACE).orderBy(*PLACE).limit(2 * k).withColumn("score", F.lit(0.0))  # of which k are left, if so few match
        return _ranked(found.unionByName(none).groupBy(*PLACE).agg(F.max("score").alias("score")), k)

    def near(self, query: str, k: int, section: str | None = None) -> DataFrame:
        """source, parent_idx, child_idx, score, rank by the boosted cosine."""
        rows = self.read("chunks").filter(bm25.section_kept(F.col("section"), section)).select(F.struct(*PLACE).alias("at"), "embedding", "boost")
        return vector.search_index(rows, "at", [vector.query_vector(query)], k, boosted=True).select("at.*", "score", "rank")

    def hybrid(self, query: str, k: int = 5, section: str | None = None) -> DataFrame:
        """rank, score, content of the k best parents: fusion.hybrid over the stored index."""
        near = self.near(query, fusion.SIDE_K, section).collect()
        if max((h["score"] for h in near), default=0.0) < fusion.LOW_CONFIDENCE:
            query, section = fusion.rewrite_text(query), None
            near = self.near(query, fusion.SIDE_K, section).collect()
        words = self.words(query, fusion.SIDE_K, section).collect()
        found = [(i, h["rank"], h["source"], h["parent_idx"]) for i, side in enumerate((near, words)) for h in side]  # 2 * SIDE_K rows
        parents = self.read("parents").filter(F.col("source").isin(sorted({f[2] for f in found})))
        met = self.spark.createDataFrame(found, "list int, rank int, source string, parent_idx int")
        both = parents.join(F.broadcast(met), ["source", "parent_idx"]).select("content", "list", "rank")
        return fusion.fuse([both.filter(F.col("list") == i) for i in (0, 1)], "content", k).select("rank", "score", "content")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    top = scored.orderBy(F.desc("score"), *PLACE).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *PLACE)))  # over k rows
