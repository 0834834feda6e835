"""Writing results: a keyed table that a second run leaves as it is, payloads of documents, and ordered exports.

Defined cases: a table that is not there yet is an empty one; rows of one key in one batch leave the one with the highest
version, of equals the one that sorts last; an empty batch changes nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.operators.text import fresh


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``); a temporary one only in a local
    session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def payload(text: str = "text", tables: str = "tables", most_chars: int = 5000, most_tables: int = 10) -> Column:
    """The nested payload of a document as JSON: its file's name, and under data its text's and tables' beginning, metrics,
    ratios and score."""
    data = F.struct("scanned", F.substring(text, 1, most_chars).alias("text"), F.slice(tables, 1, most_tables).alias("tables"), "metrics", "ratios", "score")
    return F.to_json(F.struct("filename", data.alias("data")), {"ignoreNullFields": "false"})


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row of each key: the one of the highest version. The rows are dealt by key first, so that each is sorted once."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    best = F.max(F.struct(version, *rest)).alias("best")
    return rows.repartition(*keys).groupBy(*keys).agg(best).select(*(c if c in keys else F.col(f"best.{c}").alias(c) for c in rows.columns))


def upsert(spark: SparkSession, batch: DataFrame, path: str, key: str, version: str, buckets: int = 16) -> None:
    """Merges a batch into the Parquet table at path by key. The table is laid out by buckets of the key's hash; only those
    that the batch touches are read and written anew, by dynamic overwrite, so that a batch that is run again changes
    nothing and the work follows the batch. One writer at a time.

    Rows go over the network once and are written once: dynamic overwrite writes beside the table and puts the new folders
    in the old ones' place when all rows have been read and written. Payloads are long and alike, so files are in zstd."""
    new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows = new
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except Exception as x:  # noqa: BLE001  only a missing table is an empty one
        if "PATH_NOT_FOUND" not in str(x):
            raise
    else:
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        rows = old.where(F.col("bucket").isin(touched)).select(*new.columns).unionByName(new)
    merged = latest(rows, ["bucket", key], version)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)


def export(sections: DataFrame, path: str, order: list[str], parts: int = 8) -> None:
    """Writes rows (section_no, section, then the columns of order, body) as JSON lines in the order of section and order:
    ranges go to files whose names sort as the rows do, with a running number inside each range."""
    columns = ["section_no", *order]
    sections.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export's rows with place, their number in the order of the files (from 0)."""
    rows = spark.read.schema(schema).json(path)
    file, at, k, before = fresh([*rows.columns, "place"], "file", "at", "k", "before")
    rows = rows.withColumn(file, F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn(at, F.monotonically_increasing_id())
    sizes = rows.groupBy(file).agg(F.count("*").alias(k))
    ahead = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each file
    firsts = sizes.select(file, F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(before))
    within = rows.withColumn(k, F.row_number().over(Window.partitionBy(file).orderBy(at)) - 1)
    return within.join(F.broadcast(firsts), file).withColumn("place", F.col(before) + F.col(k)).drop(file, at, k, before)
