"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from windrow.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it back."""
    target = new_folder(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def dropped(df: DataFrame) -> None:
    """Delete the folder of a stored table that nothing reads any more."""
    spark = df.sparkSession
    with contextlib.suppress(Exception):
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()[:1]}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def long_columns(rows: DataFrame) -> list[np.ndarray]:
    """Columns of longs of a bounded table as arrays; tasks send bytes, not rows."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.array([c.to_numpy().astype("<i8").tobytes()]) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(parts, batch.schema.names)

    names = rows.columns
    found = rows.mapInArrow(send, ", ".join(f"{c} binary" for c in names)).collect()
    return [np.frombuffer(b"".join(r[c] for r in found), "<i8") for c in names]


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def with_fields(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more)])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def bounded_sample(rows: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """At most ``size`` rows: those whose key hashes lowest, whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(size)
