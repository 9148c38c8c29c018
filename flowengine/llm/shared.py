"""Lineage cuts and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's spark.checkpoint.dir; a temporary folder stands in for it in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flowengine-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the shared checkpoint folder, so that later uses read it instead of computing it anew."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key: str, n: int):
    """crc32 of the key as text, modulo n: which rows a classifier may learn from."""
    return F.crc32(F.col(key).cast("string")) % n


#: Whole texts of more bytes are left out of the samples that classifiers learn from (they are scored like any other).
LONGEST = 1 << 15


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, the other columns of docs, `_label`) for at most `per_class` keys of each class that satisfy `learn`.

    Which keys is decided by their hash; at most 2 * per_class keys are broadcast. Of rows that share a key the one whose
    text has the smallest hash is taken, so the sample has at most 2 * per_class rows of LONGEST bytes.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.coalesce(learn, F.lit(False))).groupBy(key).agg(F.max(label).alias("_label"))
    some = None
    for c in (0, 1):
        part = known.where(F.col("_label") == c).orderBy(F.xxhash64(key), key).limit(per_class)
        some = part if some is None else some.unionByName(part)
    found = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= LONGEST).join(F.broadcast(some), key)
    row = F.struct(*[c for c in docs.columns if c != key], "_label")
    return found.groupBy(key).agg(F.min_by(row, F.xxhash64(text)).alias("_row")).select(key, "_row.*")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at the task's end gives freed memory back to the system: Python workers outlive their tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, **more: T.DataType) -> T.StructType:
    """The schema of df with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more.items())])
