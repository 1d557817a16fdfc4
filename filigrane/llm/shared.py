"""What the corpus operators share: reading, staging and shipping code."""

from __future__ import annotations

import atexit
import io
import os
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows of one Arrow batch; with the byte bound it keeps a batch of long texts small.
ARROW_ROWS = 1000
ARROW_BYTES = 2 << 20
#: Allocations of so many bytes go back to the system as soon as a worker frees them.
MAPPED_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors, and bound the Arrow batches of a session that doesn't bound them itself."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        spark.sparkContext.addPyFile(str(_package_zip()))
    said = spark.conf.getAll
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if f"spark.sql.execution.arrow.{key}" not in said:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return spark


def _package_zip() -> Path:
    import tempfile

    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    out = Path(tempfile.mkdtemp()) / f"{root.name}_{uuid.uuid4().hex[:8]}.zip"
    out.write_bytes(data.getvalue())
    atexit.register(lambda: out.unlink(missing_ok=True))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test layout, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share; Spark's file system removes it when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(os.environ.get("TMPDIR", "/tmp"), "filigrane-scratch")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def staged(spark: SparkSession, df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df once to the shared folder and read it back: it cuts lineage and outlives lost executors."""
    path = scratch(spark, tag)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


_libc: list = []


def lean() -> None:
    """Give a worker's free memory back to the system: Spark uses a worker for many tasks, of this and of later stages."""
    import ctypes

    import pyarrow as pa

    if not _libc:
        pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what it frees
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD, which else grows with what is freed
            _libc.append(libc.malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda _: 0)
    _libc[0](0)


def gathered(batches, least_bytes: int):
    """Arrow tables of at least so many bytes each (the last may be smaller), from an iterator of batches."""
    import pyarrow as pa

    lean()
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            part = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            yield part
            del part, batch
            lean()
    if held:
        part = pa.Table.from_batches(held).combine_chunks()
        held = batch = None
        yield part
        del part
    lean()


def column(table, name: str):
    """A column of a combined Arrow table as one array."""
    import pyarrow as pa

    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def annotated(docs: DataFrame, make, added: str, keep: list[str] | None = None, least_bytes: int = 4_000_000) -> DataFrame:
    """docs with columns that make(texts) returns for each Arrow array of texts.

    added: their DDL, "name type, ..."; a column of docs that has such a name gives way.  keep: the columns of
    docs to carry along, all if None.  make may be a function that returns such a function once a task.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    carried = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    text_at = len(carried)

    def run(batches):
        import pyarrow as pa

        work = None
        for part in gathered(batches, least_bytes):
            work = work or make()
            texts = part.column(text_at)
            texts = texts.chunk(0) if texts.num_chunks == 1 else pa.concat_arrays(texts.chunks)
            yield from pa.table([*(part.column(i) for i in range(text_at)), *work(texts)], names=[*carried, *new.names]).to_batches(max_chunksize=ARROW_ROWS)

    schema = StructType([docs.schema[c] for c in carried] + list(new.fields))
    source = docs.select(*(F.col(f"`{c}`") for c in carried), F.col("text").cast("string").alias("__text"))
    return source.mapInArrow(run, schema)


def remainder(doc_id, mod: int):
    """crc32(doc_id as text) mod a number; null for a null doc_id."""
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def hash_below(wanted: int, n: int) -> int:
    """The signed 64-bit hash up to which about wanted of n rows lie; all rows if there are no more than that."""
    return min(2**63 - 1, 2**64 * wanted // max(1, n) - 2**63)
