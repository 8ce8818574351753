"""Embedding whitening with Spark MLlib's BlockMatrix.

1. Entries become whole numbers; their sums and number are exact.  Rows are
   numbered from 0, so that they can stand in a distributed matrix.
2. Centred rows go into a ``BlockMatrix`` of ``ROWS`` rows a block.  The
   scatter matrix is its transpose times itself; the products of the blocks are
   added up in several parts of the long dimension, so no task gets them all.
3. The scatter matrix (dimensions squared, whatever the number of rows) comes to
   the driver, where ``eigh`` gives components and eigenvalues.
4. The block matrix times the whitening matrix (components over the roots of
   their eigenvalues) gives the whitened rows, which return to their vectors
   by number.  Their own covariance says how far they are from white.

Results for odd input: rows whose vector is null or empty, or holds null, NaN
or infinite entries, are left out; rows that repeat count and return each; a
null ``vec_id`` stays null; components without variance (an eigenvalue at the
rounding error of the largest one) are not returned, so equal vectors or a single
one give an empty result, as does an empty table; vectors of different lengths
have no covariance and raise ``ValueError``; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmix.llm.common import materialize, table

COMPONENTS = 32
# Entries are scaled by and moved by these, and cut down to whole numbers.
SCALE, SHIFT = 64, 1_000_000
# Rows of a block; and blocks whose products one task adds up before they meet.
ROWS, BLOCKS_IN_PART = 1024, 16
# Eigenvalues up to this part of the largest are rounding errors.
ROUNDING = 1e-11


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: the usable vectors with whole entries, ``floor(64 c) + 1000000``."""
    c = F.col(vector).cast("array<double>")
    usable = (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(usable).select(F.col(vec_id).alias("vec_id"), F.transform(
        c, lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT).alias("x"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``number``, its rows counted from 0, stored so that the numbers stay."""
    at = F.monotonically_increasing_id()
    dealt = materialize(df.select("*", F.spark_partition_id().alias("_part"),
                                  at.bitwiseAND(F.lit(2 ** 33 - 1)).alias("_at")))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each partition.
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    return (dealt.join(starts, "_part").withColumn("number", F.col("_before") + F.col("_at"))
            .drop("_part", "_at", "_before"))


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Rows ``number, v`` (an array of doubles) as a block matrix of ``dims`` columns."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("number", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(ROWS, dims)


def product(a: BlockMatrix, b: BlockMatrix, parts: int) -> BlockMatrix:
    """``a`` times ``b``, with the dimension that they share in ``parts`` parts."""
    other = b._java_matrix_wrapper._java_model
    # BlockMatrix.multiply, with the argument that Python's method leaves out.
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", other, parts), a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix, n: int) -> np.ndarray:
    """The transpose of ``m`` times ``m``: columns squared, on the driver."""
    parts = max(1, -(-n // (ROWS * BLOCKS_IN_PART)))
    return product(m.transpose(), m, parts).toLocalMatrix().toArray()


def rows_of(m: BlockMatrix) -> DataFrame:
    """``number, v`` of the rows of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("number"), vector_to_array("vector").alias("v"))


def doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are not rounding errors, falling, at most ``most``; and their vectors, as columns.

    A component's entry of the largest size is positive.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values > max(values[0], 0) * ROUNDING).sum()) if values[0] > 0 else 0
    values, vectors = values[:min(kept, most)], vectors[:, :min(kept, most)]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def whitened(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """Each usable vector on each component: a row for each pair.

    ``vec_id, component`` (from 1), ``n`` (vectors), ``deviation`` (the exact sum over
    dimensions of ``(n x - S)^2``), ``whitened``, ``explained`` (the
    component's part of the variance) and ``identity_error`` (the largest
    entry of the whitened rows' covariance minus the identity).
    """
    spark = df.sparkSession
    rows = materialize(numbered(whole_vectors(df, vec_id, vector)))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"),
                     F.max(F.size("x")).alias("dims")).first()
    n, dims = shape["n"], shape["dims"]
    nothing = rows.where("false").select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in (
        ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"))])
    if not n:
        return nothing
    if shape["least"] != dims:
        raise ValueError(f"vectors of {shape['least']} to {dims} entries have no covariance")

    totals = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    sums = F.array(*[F.lit(r["s"]).cast("bigint") for r in totals])
    # n x - S, in whole numbers.
    apart = F.zip_with("x", sums, lambda x, s: x * F.lit(n).cast("bigint") - s)
    centred = rows.select("number", F.transform(apart, lambda v: v.cast("double") / n).alias("v"))
    matrix = block_matrix(centred, n, dims)
    covariance = scatter(matrix, n) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = principal(covariance, components)
    k = len(values)
    if not k:
        return nothing
    turn = vectors / np.sqrt(values)
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, turn.ravel(order="F")))], 1)
    white = materialize(rows_of(product(matrix, BlockMatrix(local, dims, k), 1)))

    means = white.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    again = white.select("number", F.zip_with("v", doubles([r["m"] for r in means]), lambda v, m: v - m).alias("v"))
    error = float(np.abs(scatter(block_matrix(again, n, k), n) / n - np.eye(k)).max())

    trace = float(np.trace(covariance))
    deviation = F.aggregate(apart, F.lit(0).cast("bigint"), lambda total, v: total + v * v)
    parts = doubles([v / trace for v in values])
    return (rows.select("number", "vec_id", deviation.alias("deviation")).join(white, "number")
            .select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
                    "whitened", parts[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
