"""Helpers the operators share: table readers, text batches, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Upper-case A-Z become lower case; every other byte of UTF-8 text is left alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read whole through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))


def spark_ddl(schema: pa.Schema) -> str:
    """The Spark DDL of a flat Arrow schema."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean",
             pa.float64(): "double", pa.binary(): "binary",
             pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
                schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` with the output schema given once, as Arrow."""
    return df.mapInArrow(fn, spark_ddl(schema))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: pa.Schema,
             rows_per_batch: int = 512) -> DataFrame:
    """Apply a per-row function to the columns of ``df``, batch by batch.

    ``make()`` runs once per task and returns the function of one row's
    values; it may hold tables and caches.  Input is taken in slices of
    ``rows_per_batch`` rows, so a batch of very long texts is never turned
    into Python objects at once.
    """
    def run(batches):
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                columns = [c.to_pylist() for c in batch.slice(at, rows_per_batch).columns]
                out = [fn(*row) for row in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
    return map_batches(df, run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and else an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="jobmix-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder, with its lineage cut.

    A reliable checkpoint: its files outlive any executor and are removed
    when the DataFrame is no longer referenced (where Spark's cleaner is on).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
