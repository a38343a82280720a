"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that a worker turns into Python objects at once.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session, whose driver
    and executors are one process, gets a folder of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/cairnspark-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """df (a materialized table), marked for broadcast if it has at most so many rows; else a shuffle joins it."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with lines put before those that a column has already (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """df with its columns of those names (in any case of letters) called otherwise, and the columns that select df's
    own again."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    new = dict(zip(clash, fresh([*df.columns, *names, *(f"input_{n}" for n in names)], *(f"own_{c}" for c in clash))))
    return df.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]


def kept_apart(df: DataFrame, names: Iterable[str], but: str = "") -> DataFrame:
    """df with its columns of those names (in any case of letters), all but one, called input_<name>."""
    clash = [c for c in df.columns if c != but and c.lower() in {n.lower() for n in names}]
    new = fresh([*df.columns, *names], *(f"input_{c}" for c in clash))
    return df.withColumnsRenamed(dict(zip(clash, new)))


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of a schema with more fields at its end."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def unit_hash(col: str | Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value and the salt alone."""
    return F.pmod(F.xxhash64(F.col(col) if isinstance(col, str) else col, F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of `column`, so that a worker's memory does not
    depend on how many rows Spark put into a batch. A longer text is a batch of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield b.slice(s, e - s)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
