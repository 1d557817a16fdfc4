"""Reports kept with a fingerprint of what they were made from, so that only those are made anew whose input changed.

    path/generation=4    symbol, fingerprint, report of all reports made in refresh 4

A refresh writes one new generation as a whole; a symbol's report is that of its newest one.  A failed refresh
leaves a folder without _SUCCESS, which nobody reads and the next refresh replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.session import shared_path

SHAPE = "symbol string, fingerprint string, report string"


def _row_hash(kind: str, columns: list[str], seed: int) -> Column:
    """A hash of a row's values in which a null differs from an empty text and from a value elsewhere."""
    return F.xxhash64(F.lit(seed), F.lit(kind), *(x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))))


def fingerprints(parts: dict[str, DataFrame], version: str) -> DataFrame:
    """symbol, fingerprint over all rows of the parts (symbol, ...): equal if each part has the same rows, in any order, under the same version.

    One pass with sums before the shuffle; rows without a symbol take no part.
    """
    every = None
    for kind, rows in sorted(parts.items()):
        columns = sorted(c for c in rows.columns if c != "symbol")
        one = rows.filter("symbol is not null").select("symbol", *(_row_hash(kind, columns, seed).cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)))
        every = one if every is None else every.unionByName(one)
    sums = every.groupBy("symbol").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.count("*").alias("n"))
    return sums.select("symbol", F.sha2(F.concat_ws("/", F.lit(version), F.col("h1").cast("string"), F.col("h2").cast("string"), F.col("n").cast("string")), 256).alias("fingerprint"))


@dataclass
class ReportStore:
    """The reports under a path."""

    spark: SparkSession
    path: str

    def generations(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def latest(self) -> DataFrame:
        """symbol, fingerprint, report, generation: the newest report of each symbol."""
        every = self.spark.createDataFrame([], SHAPE + ", generation long")
        for g in self.generations():
            every = every.unionByName(self.spark.read.schema(SHAPE).parquet(f"{self.path}/generation={g}").withColumn("generation", F.lit(g).cast("long")))
        return every.groupBy("symbol").agg(F.max_by(F.struct("fingerprint", "report", "generation"), "generation").alias("r")).select("symbol", "r.*")

    def stale(self, now: DataFrame) -> DataFrame:
        """symbol, fingerprint of those of now (symbol, fingerprint) that have no report made from the same."""
        return now.join(self.latest().select("symbol", "fingerprint"), ["symbol", "fingerprint"], "left_anti")

    def refresh(self, now: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
        """Make the stale reports; how many. build(symbols) gives symbol, report for a table of symbols."""
        where = shared_path(self.spark, "stale")
        self.stale(now).write.parquet(where)
        stale = self.spark.read.schema("symbol string, fingerprint string").parquet(where)
        n = stale.count()
        if n:
            made = build(stale.select("symbol")).join(stale, "symbol").select("symbol", "fingerprint", "report")
            made.write.mode("overwrite").parquet(f"{self.path}/generation={max(self.generations(), default=0) + 1}")
        return n

    def report(self, symbol: str) -> str | None:
        """The stored report of a symbol, whatever its case, or None."""
        found = self.latest().filter(F.lower("symbol") == symbol.strip().lower()).select("report").head(1)
        return found[0][0] if found else None
