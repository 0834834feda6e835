"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; a temporary one only in a local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (Spark compares without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def digest64(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items))


def pair_of_longs(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two signed 64-bit numbers."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2) if digests else np.empty((0, 2), "<i8")


def in_parts(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts with so many bytes of the column text at most; a longer text stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
