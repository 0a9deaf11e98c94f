"""Exact duplicates by a tree merge of sorted digest runs.

Each partition reduces its rows to a sorted run with one row for each digest. Partitions
then exchange runs in binomial rounds, as in a hypercube: in a round a partition keeps the
part of the digest space that some bits of its number stand for and gets the same part
from its partners, sorts what came in (spilling if need be) and merges it in one pass. After
the last round a partition owns a slice of the digest space. A digest has one row in every
run, so a text that a third of all rows share is never gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import whole_text

#: Characters that do not count. Fixed value.
IGNORED = r"[\x20\x09-\x0D]+"
#: Bits of the partition number settled in a round: 2^3 runs are merged at once.
BITS = 3
RUN = "digest binary, n_bytes long, points long, keep_id long, rows long, at int"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, IGNORED, "")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digest (SHA-256 of the normalised text), its length in bytes, code points of the original."""
    text = whole_text()
    flat = normalised(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(flat.cast("binary"), 256)).alias("digest"),
        F.octet_length(flat).cast("long").alias("n_bytes"),
        F.length(text).cast("long").alias("points"),
    )


def merge_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows that come sorted by digest to one row each; the open digest is carried to the next batch.

    A digest counts as the same text only if the lengths agree as well. Of equal texts the
    one with the most code points stays, then the smallest id (null ids last).
    """
    carried: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carried is not None:
            rows = pa.concat_tables([carried, rows])
        merged = reduce_rows(rows)
        carried = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).combine_chunks().to_batches()
    if carried is not None:
        yield from carried.combine_chunks().to_batches()


def reduce_rows(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    n = rows.num_rows
    digest = rows.column("digest").combine_chunks()
    raw = np.frombuffer(b"".join(digest.to_pylist()), "S32") if n else np.zeros(0, "S32")
    words = raw.view(np.uint64).reshape(n, 4)
    size = rows.column("n_bytes").to_numpy()
    same = (words[1:] == words[:-1]).all(axis=1) & (size[1:] == size[:-1])
    start = np.flatnonzero(np.r_[True, ~same])
    group = np.cumsum(np.r_[True, ~same]) - 1
    points = rows.column("points").to_numpy()
    keep = rows.column("keep_id")
    known = keep.is_valid().to_numpy()
    ids = keep.fill_null(0).to_numpy()
    best = np.lexsort((ids, ~known, -points, group))[start]  # the first of each group in this order
    return pa.table(
        {
            "digest": digest.take(pa.array(start)),
            "n_bytes": pa.array(size[start]),
            "points": pa.array(points[best]),
            "keep_id": pa.array(ids[best], mask=~known[best]),
            "rows": pa.array(np.add.reduceat(rows.column("rows").to_numpy(), start)),
            "at": rows.column("at").take(pa.array(start)),
        },
        schema=rows.schema,
    )


def merge_tree(found: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each text of ``found`` (see digests): digest, n_bytes, keep_id, rows."""
    depth = max(1, (max(1, found.rdd.getNumPartitions()) - 1).bit_length())
    order = ["digest", "n_bytes"]
    runs = found.select("digest", "n_bytes", "points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("rows"), (F.spark_partition_id() % (1 << depth)).cast("int").alias("at"))
    runs = runs.sortWithinPartitions(*order).mapInArrow(merge_sorted, RUN)
    # the owner of a digest, from its first four bytes
    owner = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - depth).cast("int")
    for low in reversed(range(0, depth, bits)):
        mask = ((1 << min(bits, depth - low)) - 1) << low
        to = F.col("at").bitwiseAND(~mask).bitwiseOR(owner.bitwiseAND(mask))
        runs = runs.withColumn("at", to).repartitionById(1 << depth, F.col("at")).sortWithinPartitions(*order).mapInArrow(merge_sorted, RUN)
    return runs.select("digest", "n_bytes", "keep_id", "rows")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: (doc_id, keep_id, group_size, kept, digest).

    Null texts are empty; empty texts form one group. Ties in length go to the smallest
    doc_id. A null doc_id comes last; it is kept only where no row of its group has an id.
    Repeated rows (same id, same text) are counted each and get the same verdict; other
    columns are not read; an empty table gives no rows.
    """
    found = cut(digests(docs))
    groups = merge_tree(found)
    return found.join(groups, ["digest", "n_bytes"]).select(
        "doc_id", "keep_id", F.col("rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of a row repeated with its id, one."""
    kept = cut(exact_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__kept")))
    marked = docs.withColumn("__digest", F.unhex(F.sha2(normalised(whole_text()).cast("binary"), 256)))
    named = marked.join(kept.where("__id is not null"), (marked["doc_id"] == kept["__id"]) & (marked["__digest"] == kept["__kept"]), "left_semi")
    nameless = marked.where("doc_id is null").join(kept.where("__id is null"), marked["__digest"] == kept["__kept"], "left_semi")
    out = named.dropDuplicates(["doc_id", "__digest"]).unionByName(nameless.dropDuplicates(["__digest"]))
    return out.drop("__digest")
