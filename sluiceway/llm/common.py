"""What the operators of this package share: columns, batches and small helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

#: Whitespace by Unicode's White_Space property. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 5 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(df: DataFrame) -> Column:
    """crc32(doc_id as text) mod 5; 0 is the held-out fold. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """A function for mapInArrow that calls ``fn`` on parts of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)

    return run


def distinct_words(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which distinct word each word of a list array is, and the distinct words: each is then looked up once."""
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], ..., starts[i] + sizes[i] - 1 for all i, one after the other (32 bits: for parts of a task)."""
    ends = np.cumsum(sizes, dtype=np.int32)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do so."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_KEPT: dict[str, object] = {}


def once_per_worker(key: str, make: Callable[[], object]):
    """The object of the latest ``key``, made once in each Python worker.

    Workers serve one operator after the other; what the one before kept is let go before the next is made.
    Caches refer to themselves through their methods, and their strings never make the collector run by itself.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def add_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def labelled_sample(rows: DataFrame, docs: DataFrame, label: str, per_label: int, chars: int) -> list[tuple[str, object]]:
    """(text, label) of a bounded sample: at most ``per_label`` rows of each label, ``chars`` characters of each.

    ``rows`` has doc_id and the label. Rows are chosen by a hash of the id, so the same rows come
    whatever the partitions; the held-out fold and rows without a label are left out. The ids
    chosen are few by construction and are broadcast; only their texts reach the driver.
    """
    known = rows.where(F.col(label).isNotNull() & (fold(rows) != 0)).select("doc_id", label)
    first = W.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= per_label).select("doc_id", F.col(label).alias("__label"))
    texts = docs.select("doc_id", F.substring(whole_text(), 1, chars).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "__label").collect()
    return [(r["text"], r["__label"]) for r in sorted(found, key=lambda r: (r["doc_id"], str(r["__label"]), r["text"]))]
