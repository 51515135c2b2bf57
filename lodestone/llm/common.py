"""What the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage and survives lost executors; ``level``: of compression."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c):
    return F.translate(c, UPPER, UPPER.lower())


def n_words(text):
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, most_bytes: int = 4 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive slices of a batch: about ``most_bytes`` each, a longer text alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and (held + size > most_bytes or k - at >= most_rows):
            yield at, k - at
            at, held = k, 0
        held += int(size)
    if len(sizes) > at:
        yield at, len(sizes) - at


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 1) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal ``keys``; the rows come sorted by them.

    A table has ``least_rows`` rows or more where the input has, and never more than one group beyond that."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, least_rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(rows, bool)
        for k in keys:
            same &= np.asarray(pc.equal(table[k], table[k][rows - 1]))
        cut = rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            table, rows, enough = table.slice(cut), rows - cut, least_rows
        else:
            enough = 2 * rows
        held = table.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
