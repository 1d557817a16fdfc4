"""Writers: reports, uploads, registered symbols. A report is read back if it is there, so that it isn't made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder a symbol (lower case), replaced as a whole: a reader never sees half a report."""
    rows = reports.select(F.lower("symbol").alias("symbol"), F.col("report").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").option("lineSep", "\n").text(path)


def cached_report(spark: SparkSession, path: str, symbol: str) -> str | None:
    """The stored report of a symbol, or None. Found by its partition, as a folder's name escapes what a symbol may hold."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema("value string, symbol string").text(path, wholetext=True).filter(F.col("symbol") == symbol.lower()).select("value").collect()  # one report
    return rows[0][0] if rows else None


def register_symbol(spark: SparkSession, path: str, ticker: str | None) -> None:
    """Append a ticker to the table of symbols. ValueError without one."""
    if not (ticker or "").strip():
        raise ValueError("a ticker is needed")
    spark.createDataFrame([(ticker.strip().lower(),)], "symbol string").write.mode("append").parquet(path)


def download(spark: SparkSession, url: str, path: str, symbol: str, name: str, headers: dict[str, str] | None = None, timeout: float = 30) -> int:
    """Store what a URL returns in the landing folder of a symbol, piece by piece; the count of bytes.

    ValueError if it is empty (nothing is left then); what the request or the file system raises goes through.
    """
    from urllib.request import Request, urlopen

    target, fs = _target(spark, path, symbol, name)
    size = 0
    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as answer:
        out = fs.create(target, True)
        try:
            while piece := answer.read(1 << 20):
                out.write(bytearray(piece))
                size += len(piece)
        finally:
            out.close()
    if not size:
        fs.delete(target, False)
        raise ValueError("the download is empty")
    return size


def ingest(spark: SparkSession, path: str, symbol: str, uploads: dict[str, bytes], urls: dict[str, str], regenerate=None, required: tuple[str, ...] = ("annual_report.pdf",)) -> list[str]:
    """Save uploads (name: bytes) and downloads (name: URL), then call regenerate(symbol) if anything was saved; the names saved.

    A download that fails is an error if its name is required, else it is left out; so is a failed regeneration.
    """
    saved = []
    for name, url in urls.items():
        try:
            download(spark, url, path, symbol, name)
            saved.append(name)
        except (OSError, ValueError):
            if name in required:
                raise
    for name, content in uploads.items():
        save_upload(spark, path, symbol, name, content)
        saved.append(name)
    if saved and regenerate is not None:
        try:
            regenerate(symbol)
        except Exception:  # the files are saved; the report can be made again later
            return saved
    return saved


def _target(spark: SparkSession, path: str, symbol: str, name: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{symbol.strip().lower()}/{name}")
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def move_files(spark: SparkSession, path: str, out: str, by: str, kind: str) -> int:
    """Give the files that executors wrote under path/by=value the names value.kind in out; how many. Only names pass the driver.

    Of a folder with several files, all but the first are numbered.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(out)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    moved = 0
    for folder in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        if folder.isDirectory() and folder.getPath().getName().startswith(f"{by}="):
            value = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName().split("=", 1)[1])
            files = [f.getPath() for f in fs.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", "."))]
            for k, own in enumerate(files):
                moved += fs.rename(own, jvm.org.apache.hadoop.fs.Path(target, f"{value}{f'_{k}' if k else ''}.{kind}"))
    return moved


def save_upload(spark: SparkSession, path: str, symbol: str, name: str, content: bytes) -> str:
    """Store an upload in the landing folder of a symbol, by any file system Spark knows. ValueError if it is empty."""
    if not content:
        raise ValueError("the upload is empty")
    target, fs = _target(spark, path, symbol, name)
    out = fs.create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return target.toString()
