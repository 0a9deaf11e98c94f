"""Vector code compression: product codes learned with integer arithmetic on value dictionaries.

Every component becomes an integer. A block of vectors keeps, for each dimension, a dictionary
of the distinct integers in it and one code for each vector. For a codebook, the squared
differences of all dictionary values to all entries are tabulated once per block; the distance
of a part to an entry is then a sum of gathered table cells, without arithmetic on vectors.

Blocks are stored once in the shared folder. A round is one pass over them that sends counts
and sums of entries, never vectors: their number is fixed by the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.skew import is_small
from ..session import new_folder
from .common import batch_rows

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components of a block; its rows are as many as fit, and few enough for 16-bit codes.
CELLS = 1 << 18
MAX_ROWS = 1 << 16
#: Blocks handed to a Python worker at once.
BLOCKS_AT_ONCE = 4

Codebooks = list[list[list[int]]]  # part, entry, position within the part


class Compressed(NamedTuple):
    """``codes``: vec_id, label, code (binary, one byte for each part), error. ``codebooks``: final entries."""

    codes: DataFrame
    codebooks: Codebooks


# ---- blocks


def integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have finite components only, and floor(scale * x) of these as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    keep = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    found = np.unique(sizes[keep])
    if len(found) > 1:
        raise ValueError(f"vectors of different lengths: {found.tolist()}")
    dims = int(found[0]) if len(found) else 0
    kept = flat[np.repeat(keep, np.maximum(sizes, 0))].reshape(int(keep.sum()), dims)
    return keep, whole(kept, scale)


def whole(components: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), refused where the squared distance of two vectors would not fit into 64 bits."""
    dims = max(1, components.shape[1])
    limit = min(isqrt((2**63 - 1) // (4 * dims)), 2**30)
    out = np.floor(components * float(scale))
    if out.size and max(out.max(), -out.min()) > limit:
        raise ValueError(f"components beyond {limit / scale}: their distances do not fit into 64 bits")
    return out.astype(np.int64)


class Block(NamedTuple):
    """Codes (dimension by row, 16 bits) into the dictionaries of all dimensions, one after the other."""

    codes: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, ints: np.ndarray) -> Block:
        n, dims = ints.shape
        codes, values, starts = np.empty((dims, n), np.uint16), [], [0]
        for d in range(dims):
            own, codes[d] = np.unique(ints[:, d], return_inverse=True)
            values.append(own)
            starts.append(starts[-1] + len(own))
        return cls(codes, np.concatenate([np.zeros(0, np.int64), *values]), np.array(starts, np.int64))

    def dictionary(self, d: int) -> np.ndarray:
        return self.values[self.starts[d] : self.starts[d + 1]]

    def nearest(self, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part: the nearest entry of every row (ties to the lower index) and its squared distance."""
        width = len(self.codes) // len(books)
        n = self.codes.shape[1]
        for part, book in enumerate(books):
            far = np.zeros((len(book), n), np.int64)
            for i in range(width):
                d = part * width + i
                table = (book[:, i, None] - self.dictionary(d)) ** 2
                far += table[:, self.codes[d]]
            best = far.argmin(axis=0)
            yield best, far[best, np.arange(n)]

    def sums(self, part: int, width: int, best: np.ndarray, entries: int) -> np.ndarray:
        """Sum of the rows of each entry (entry by position). Doubles hold it: 2**16 rows of 30 bits at most."""
        out = np.empty((entries, width), np.int64)
        for i in range(width):
            d = part * width + i
            out[:, i] = np.bincount(best, self.dictionary(d)[self.codes[d]], entries)
        return out

    def rows(self, which: np.ndarray) -> np.ndarray:
        return np.array([self.dictionary(d)[c[which]] for d, c in enumerate(self.codes)], np.int64).reshape(len(self.codes), len(which)).T


def _blocks_of(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """(vec_ids, labels, dims, codes, values, starts): a row for each block."""
    label = vectors.schema["label"].dataType
    schema = T.StructType(
        [
            T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("dims", T.IntegerType()),
            T.StructField("codes", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("starts", T.BinaryType()),
        ]
    )

    def listed(a: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ints = integers(batch.column(2), scale)
            if ints.shape[1] % parts:
                raise ValueError(f"{ints.shape[1]} components cannot be cut into {parts} equal parts")
            batch = batch.select([0, 1]).filter(pa.array(keep))
            step = min(MAX_ROWS, max(1, CELLS // max(1, ints.shape[1])))
            for at in range(0, len(ints), step):
                block, held = Block.of(ints[at : at + step]), batch.slice(at, step)
                cols = [listed(held.column(0)), listed(held.column(1)), pa.array([ints.shape[1]], pa.int32())]
                cols += [pa.array([a.tobytes()], pa.binary()) for a in block]
                yield pa.record_batch(cols, names=schema.names)

    return vectors.mapInArrow(run, schema)


def _read(batch: pa.RecordBatch, row: int) -> Block:
    dims = batch.column(2)[row].as_py()
    codes, values, starts = (batch.column(k)[row].as_buffer() for k in (3, 4, 5))
    codes = np.frombuffer(codes, np.uint16)
    n = len(batch.column(0)[row])
    return Block(codes.reshape(dims, n), np.frombuffer(values, np.int64), np.frombuffer(starts, np.int64))


# ---- codebooks


def _first_vectors(blocks: DataFrame, entries: int) -> np.ndarray:
    """Vectors of the smallest ids (ties by their components; rows without an id come last), a few from each task."""

    def run(batches):
        found: list[tuple] = []
        for batch in batches:
            for row in range(batch.num_rows):
                block = _read(batch, row)
                ids = batch.column(0)[row].values
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                # all rows that tie with the last id taken are looked at
                order = np.lexsort((number, missing))
                last = order[min(entries, len(order)) - 1]
                own = np.flatnonzero((missing < missing[last]) | ((missing == missing[last]) & (number <= number[last])))
                found += zip(missing[own].tolist(), number[own].tolist(), block.rows(own).tolist())
                found = sorted(found)[:entries]
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.bool_(), pa.int64(), pa.list_(pa.int64())))], names=["missing", "id", "v"])

    with batch_rows(blocks.sparkSession, BLOCKS_AT_ONCE):
        first = blocks.mapInArrow(run, "missing boolean, id long, v array<long>").orderBy("missing", "id", "v").limit(entries).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)


def _totals(blocks: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Per (part, entry) that has rows: their number and componentwise sum."""

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                block = _read(batch, row)
                for part, (best, _) in enumerate(block.nearest(books)):
                    counts[part] += np.bincount(best, minlength=len(books[part]))
                    sums[part] += block.sums(part, books[part].shape[1], best, len(books[part]))
        cols: list[list] = [[], [], [], [], []]
        for part, (n, s) in enumerate(zip(counts, sums)):
            for entry in np.flatnonzero(n):
                # position -1 carries the count, so that parts without positions have one as well
                for position, value in [(-1, int(n[entry])), *enumerate(s[entry].tolist())]:
                    for col, x in zip(cols, (part, int(entry), position, Decimal(value))):
                        col.append(x)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(20, 0))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "entry", "position", "total"])

    with batch_rows(blocks.sparkSession, BLOCKS_AT_ONCE):
        sent = blocks.mapInArrow(run, "part int, entry int, position int, total decimal(20,0)")
        rows = sent.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect()  # at most a row for each number of the codebooks
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        key, total = (r["part"], r["entry"]), int(r["total"])
        if r["position"] < 0:
            out[key] = (total, [])
        else:
            out[key][1].append(total)
    return out


def learn(blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebook of each part (entry by position), after ``rounds`` rounds; none of a table without vectors."""
    first = _first_vectors(blocks, entries)
    if not len(first):
        return []
    books = [np.ascontiguousarray(b) for b in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for (part, entry), (n, sums) in _totals(blocks, books).items():
            books[part][entry] = [s // n for s in sums]  # floors of exact integers go down
    return books


# ---- the operator


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, column: str = "embedding"
) -> Compressed:
    """Product codes of all vectors and the codebooks they refer to.

    Rows whose vector is null or holds a null, NaN or infinite component are left out. All
    other vectors must have one length that ``parts`` divides, and components whose squared
    distances fit into 64 bits (up to 46,000 at 64 dimensions); anything else raises
    ValueError. A null vec_id stays null and is taken for a codebook only after all others;
    of repeated ids the vector with smaller components comes first; repeated rows are coded
    once each. With fewer vectors than ``entries``, codebooks have as many entries as there
    are vectors. An empty table gives no rows and no codebooks. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col(column).cast("array<double>").alias("v"))
    blocks = _stored(_blocks_of(typed.where(F.col("v").isNotNull()), scale, parts))
    lengths = [r["dims"] for r in blocks.select("dims").distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    books = learn(blocks, parts, entries, rounds)
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()), T.StructField("label", typed.schema["label"].dataType),
            T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column(0)[row].values, batch.column(1)[row].values
                code, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for part, (best, far) in enumerate(_read(batch, row).nearest(books)):
                    code[:, part] = best
                    error += far
                coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(ids), [None, pa.py_buffer(code.tobytes())])
                yield pa.record_batch([ids, labels, coded.cast(pa.binary()), pa.array(error)], names=schema.names)

    with batch_rows(spark, BLOCKS_AT_ONCE):
        coded = _stored(blocks.mapInArrow(run, schema))
    return Compressed(coded, [b.tolist() for b in books])


def _stored(df: DataFrame) -> DataFrame:
    """Like session.cut, in small row groups: a block is a wide row."""
    path = new_folder(df.sparkSession, "cut/vectors")
    df.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def codebooks_sha256(books: Codebooks) -> str:
    """Digest of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def decode(code: bytes, books: Codebooks, scale: int = SCALE) -> list[float]:
    """The vector a code stands for: the middle of each entry's cell of the integer grid."""
    return [(x + 0.5) / scale for part, entry in enumerate(code) for x in books[part][entry]]


def label_errors(codes: DataFrame, name: str = "label_error") -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together.

    Errors are added up before the shuffle, so a hot label is one row per task. The sums go
    back by a broadcast where the table they come from is small, and otherwise by a shuffle join
    whose hot partitions adaptive execution splits.
    """
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias(name))
    sums = F.broadcast(sums) if is_small(codes.select("label")) else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def hex_code(column: str = "code") -> Column:
    return F.lower(F.hex(column))
