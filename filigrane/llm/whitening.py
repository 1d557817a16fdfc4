"""Whitening of embeddings from exact integer sums.

Components become integers.  Their scatter matrix is summed modulo several primes, by matrix products of residues
that are exact in double precision, one small matrix a partition; the sums of the partitions are added up and the
integers rebuilt by Chinese remainders.  So the covariance is exact however many rows there are, in whatever
order they come, before its eigenvectors are taken in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.shared import ARROW_ROWS, lean, prepare, staged, table

SCALE = 256
COMPONENTS = 4
#: Rows of one product: residues are below 2**20, so that sums of so many products stay below 2**53.
PRODUCT_ROWS = 4096
PRIME_BITS = 20
#: Of vectors this long one matrix of residues is some 0.5 GB; longer ones are refused.
MOST_DIMENSIONS = 8192


def primes(least_product: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS whose product passes a number."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= least_product:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residue_products(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """x' x modulo each prime, of an int64 matrix."""
    out = []
    for p in moduli:
        total = np.zeros((x.shape[1], x.shape[1]), np.int64)
        for at in range(0, len(x), PRODUCT_ROWS):
            r = np.mod(x[at : at + PRODUCT_ROWS], p).astype(np.float64)
            total = (total + (r.T @ r).astype(np.int64) % p) % p
        out.append(total)
    return out


def rebuilt(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def packed(vectors: list) -> list[bytes]:
    """floor(SCALE * c) of each component as bytes: equal vectors, equal bytes; zeros at the end count for nothing.

    A number outside 64 bits becomes the nearest one inside.
    """
    out = []
    for v in vectors:
        real = np.floor(SCALE * np.asarray(v, np.float64))
        x = np.where(real >= 2.0**63, np.iinfo(np.int64).max, np.where(real < -(2.0**63), np.iinfo(np.int64).min, np.clip(real, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
        ends = np.flatnonzero(x)
        x = x[: ends[-1] + 1] if ends.size else x[:0]
        size = next(s for s in (1, 2, 4, 8) if not x.size or (-(1 << 8 * s - 1) <= int(x.min()) and int(x.max()) < 1 << 8 * s - 1))
        out.append(bytes([size]) + x.astype(f"<i{size}").tobytes())
    return out


def unpacked(values: list[bytes], width: int) -> np.ndarray:
    """The rows of an int64 matrix, shorter ones filled with zeros."""
    out = np.zeros((len(values), width), np.int64)
    for row, v in zip(out, values, strict=True):
        own = np.frombuffer(v, f"<i{v[0]}", offset=1)
        row[: len(own)] = own
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the packed vector (x) of the rows whose vector is not null and holds finite numbers only."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("embedding")
            flat, cuts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())[:-1]
            x = packed(np.split(flat, cuts) if len(column) else [])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(x, pa.binary())], names=["vec_id", "x"])
        lean()

    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("embedding is not null").filter(~bad).mapInArrow(pack, "vec_id long, x binary")


def moments(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the scatter matrix of distinct packed vectors, exactly; what reaches the driver grows with the dimensions only."""
    spark = fit.sparkSession

    def measure(batches):
        import pyarrow as pa

        n, wide, most = 0, 0, 0
        for batch in batches:
            for v in batch.column("x").to_pylist():
                own = np.frombuffer(v, f"<i{v[0]}", offset=1)
                n, wide = n + 1, max(wide, len(own))
                if own.size:
                    most = max(most, -int(own.min()), int(own.max()))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([wide]), pa.array([str(most)])], names=["n", "width", "most"])

    told = fit.mapInArrow(measure, "n long, width long, most string").agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.max(F.col("most").cast("decimal(38,0)")).alias("most")).first()
    n, width, most = int(told["n"] or 0), int(told["width"] or 0), int(told["most"] or 0)
    if width > MOST_DIMENSIONS:
        raise ValueError(f"a vector of {width} components; the most is {MOST_DIMENSIONS}")
    if not n:
        return 0, [], []
    moduli = primes(2 * n * max(1, most) ** 2)
    upper = np.triu_indices(width + 1)  # a component of ones gives S and n

    def scatter(batches):
        import pyarrow as pa

        sums = [np.zeros((width + 1, width + 1), np.int64) for _ in moduli]
        for batch in batches:
            values = batch.column("x").to_pylist()
            for at in range(0, len(values), PRODUCT_ROWS):
                x = unpacked(values[at : at + PRODUCT_ROWS], width)
                x = np.column_stack([x, np.ones(len(x), np.int64)])
                sums = [(a + b) % p for a, b, p in zip(sums, residue_products(x, moduli), moduli, strict=True)]
        for k, total in enumerate(sums):
            flat = total[upper]
            for at in range(0, len(flat), 1 << 16):
                part = flat[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["prime", "cell", "residue"])
        lean()

    added = fit.mapInArrow(scatter, "prime int, cell long, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue"))
    cells: list[list[int]] = [[0] * len(upper[0]) for _ in moduli]
    for batch in added.toArrow().to_batches():  # one row a prime and pair of dimensions
        for k, at, r in zip(*(batch.column(c).to_pylist() for c in ("prime", "cell", "residue")), strict=True):
            cells[k][at] = r % moduli[k]
    whole = [[0] * (width + 1) for _ in range(width + 1)]
    for i, j, *residues in zip(*(u.tolist() for u in upper), *cells, strict=True):
        whole[i][j] = whole[j][i] = rebuilt(residues, moduli)
    assert whole[width][width] == n
    return n, whole[width][:width], [row[:width] for row in whole[:width]]


def principal(n: int, sums: list[int], scatter: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of the covariance, their unit vectors (in columns) and its trace.

    Only components whose eigenvalue is above rounding are given.  A vector's largest entry is positive.
    """
    d = len(sums)
    if not d:
        return np.zeros(0), np.zeros((0, 0)), 0.0
    exact = [[n * scatter[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    v = np.array([[c / (n * n) for c in row] for row in exact])  # Python divides integers of any size with one rounding
    trace = sum(exact[i][i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > d * np.finfo(np.float64).eps * max(values[0], 0.0)
    values, vectors = values[real], vectors[:, real]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))]), trace


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text of every usable row and component.

    vectors: vec_id, embedding; other columns, whatever their names, are ignored.  Rows whose embedding is null or
    holds a null or a number that isn't finite are left out; a null vec_id is kept as it is.  The fit takes each
    distinct integer vector once, so rows that repeat change nothing and get equal results.  A shorter vector
    counts as filled with zeros to the length of the longest (longer ones than MOST_DIMENSIONS are refused by a
    ValueError), a scaled component outside 64 bits as the nearest number inside.  deviation is null where it passes 64 bits; deviation_text
    always has its digits.  Components whose eigenvalue is zero within rounding have no whitened values and are left
    out, so that a table of equal vectors, like an empty one, gives no rows.  Equal eigenvalues share a plane, in
    which the vectors may lie in any way.  Runs jobs, and stages the distinct vectors.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    fit = staged(spark, rows.select("x").distinct(), "fit")
    n, sums, scatter = moments(fit)
    values, basis, trace = principal(n, sums, scatter, components)
    width, found = len(sums), len(values)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    if not found:
        return spark.createDataFrame([], shape)
    # x - S/n as x - floor(S/n) - rest/n, so that large means cost no digits
    whole, rest = [s // n for s in sums], np.array([s % n / n for s in sums])
    small = all(abs(w) < 1 << 62 for w in whole)

    def centred(x: np.ndarray) -> np.ndarray:
        near = (x - np.array(whole, np.int64)) if small and np.abs(x, dtype=object).max(initial=0) < 1 << 62 else (x.astype(object) - np.array(whole, object))
        return near.astype(np.float64) - rest

    def project(x: np.ndarray) -> np.ndarray:
        return centred(x) @ basis / np.sqrt(values)

    def deviations(x: np.ndarray) -> list[int]:
        most = int(max(-int(x.min()), int(x.max()), 0)) if x.size else 0
        fits = width * (n * most + max(map(abs, sums), default=0)) ** 2 < 1 << 63
        kind = np.int64 if fits else object
        return ((n * x.astype(kind) - np.array(sums, kind)) ** 2).sum(1).tolist()

    names = [f"w{k}" for k in range(found)]

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            w = project(unpacked(batch.column("x").to_pylist(), width))
            yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in w.T], names=names)

    scores = fit.mapInArrow(score, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(found) for j in range(i + 1)]
    got = scores.agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()  # centred, merged partition by partition
    error = max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True))
    share = [float(e) / trace for e in values]

    def every(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), ARROW_ROWS):
                part = batch.slice(at, ARROW_ROWS)
                x = unpacked(part.column("x").to_pylist(), width)
                w, away, m = project(x), deviations(x), len(x)
                take = pa.array(np.repeat(np.arange(m), found))
                digits = pa.array([str(a) for a in away]).take(take)
                fitting = pa.array([a if a < 1 << 63 else None for a in away], pa.int64()).take(take)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)), pa.array(np.full(m * found, n)), fitting, pa.array(w.ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * found, error)), digits,
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])
        lean()

    return rows.mapInArrow(every, shape)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    prepare(spark)
    return whitened(table(spark, sf_dir, "embeddings"))
