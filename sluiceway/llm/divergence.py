"""Divergence of sources: how far the terms of a source lie from those of another source of its language.

1. Texts become terms in tasks; each slice of texts sends one row per (lang, source, term).
2. Terms of a language get numbers by falling frequency, so terms of like counts are neighbours.
3. A chunk of terms keeps, for each source and each count of it, the bitset of the terms with
   that count there, without its empty words. For two sources, AND and popcount of their
   bitsets give the joint cells (count here, count there); each cell is multiplied by f of the
   two probabilities. Cells with a zero on one or both sides follow by complement.

All arithmetic is in integers. Probabilities are parts of 10**9, see ``probability``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import prefix_scan
from ..functions.skew import is_small
from ..session import cut
from .common import distinct_words, per_slice, whole_text

#: Everything but letters of ASCII and what lies beyond ASCII parts terms; A-Z become a-z. Fixed rule.
LETTERS = bytes((b | 0x20 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS = 3
TOP = 200
#: Terms of a chunk, 64 to a word of a bitset.
CHUNK = 1 << 14
#: About as many sources of a language meet in one task.
TILE = 64
SLICE_BYTES = 8 << 20

COUNTS = "lang string, source string, term string, n long, docs long"


# ---- counts


def _lowered(text: pa.Array) -> pa.Array:
    """The texts with letters lowered and every other ASCII character blank, byte by byte."""
    text = text.cast(pa.string())
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = data[int(ends[0]) : int(ends[-1])].to_pybytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(text), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(data.translate(LETTERS)))


def count_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some texts, and a row without a term for every (lang, source)."""
    lists = pc.ascii_split_whitespace(_lowered(batch.column(2)))
    code, words = distinct_words(lists)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    near = len(source.dictionary)
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * near + source.indices.to_numpy(zero_copy_only=False)
    wide = max(1, len(words))
    once, n = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * wide + code, return_counts=True)
    key = group[once // wide] * wide + once % wide
    order = np.argsort(key, kind="stable")
    found, first = np.unique(key[order], return_index=True)
    n = np.add.reduceat(n[order], first) if len(found) else np.zeros(0, np.int64)
    docs = np.diff(np.r_[first, len(key)])
    blank = words.index("").as_py() if len(words) else -1
    real = found % wide != blank
    found, n, docs = found[real], n[real], docs[real]
    own = np.unique(group)
    owner = np.r_[found // wide, own]
    terms = words.take(pa.array(found % wide)) if len(words) else pa.array([], pa.string())
    return pa.record_batch(
        [
            lang.dictionary.take(pa.array(owner // near)), source.dictionary.take(pa.array(owner % near)),
            pa.concat_arrays([terms, pa.nulls(len(own), pa.string())]),
            pa.array(np.r_[n, np.zeros(len(own), np.int64)]), pa.array(np.r_[docs, np.zeros(len(own), np.int64)]),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of each term by (lang, source), and the rows that have it; each pair also has a row without a term."""
    flat = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], whole_text().alias("text"))
    sent = flat.mapInArrow(per_slice(count_slice, "text", SLICE_BYTES), COUNTS)
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- arithmetic


def probability(n: str, total: str) -> Column:
    """1 + floor(10**9 * (n + 1) / total), in 64 bits where they hold the product and in decimals beyond."""
    short = f"(1000000000 * ({n} + 1)) div {total}"
    wide = f"(cast(1000000000 as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} as decimal(20,0))"
    return F.expr(f"1 + case when {n} < 9000000000 then {short} else {wide} end")


def excess(p: str, q: str) -> Column:
    """f: floor((p - q)**2 / q). Probabilities reach 10**9 + 1, so 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


# ---- bitsets of one chunk


class Levels:
    """The terms of one source in a chunk: a bitset for each count, kept as its non-empty words."""

    def __init__(self, bits: np.ndarray, count: np.ndarray, p: np.ndarray, p_zero: int):
        order = np.lexsort((bits, count))
        bits, count, p = bits[order], count[order], p[order]
        first = np.flatnonzero(np.r_[True, count[1:] != count[:-1]]) if len(count) else np.zeros(0, np.int64)
        level = np.zeros(len(count), np.int64)
        level[first[1:]] = 1
        level = np.cumsum(level)
        self.p, self.size, self.p_zero = p[first], np.diff(np.r_[first, len(count)]), np.int64(p_zero)
        word = bits >> 6
        start = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (level[1:] != level[:-1])]) if len(word) else np.zeros(0, np.int64)
        packed = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)
        order = np.argsort(word[start], kind="stable")
        self.word, self.level, self.bits = word[start][order], level[start][order], packed[order]
        self.own, self.first = np.unique(self.word, return_index=True)
        self.many = np.diff(np.r_[self.first, len(self.word)])


def joint_cells(a: Levels, b: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level of a, level of b, terms) with both counts above zero: AND and popcount, word by word."""
    _, i, j = np.intersect1d(a.own, b.own, assume_unique=True, return_indices=True)
    na, nb = a.many[i], b.many[j]
    pairs = na * nb
    nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    nb = np.repeat(nb, pairs)
    x, y = np.repeat(a.first[i], pairs) + nth // nb, np.repeat(b.first[j], pairs) + nth % nb
    terms = np.bitwise_count(a.bits[x] & b.bits[y]).astype(np.int64)
    hit = np.flatnonzero(terms)
    return a.level[x[hit]], b.level[y[hit]], terms[hit]


def divergences(a: Levels, b: Levels, terms: int) -> tuple[int, int]:
    """Sum of f over the ``terms`` of a chunk: of a from b, and of b from a."""
    la, lb, n = joint_cells(a, b)
    only_a = a.size - np.bincount(la, n, len(a.size)).astype(np.int64)
    only_b = b.size - np.bincount(lb, n, len(b.size)).astype(np.int64)
    none = terms - int(n.sum() + only_a.sum() + only_b.sum())

    def of(f) -> int:
        both = (n * f(a.p[la], b.p[lb])).sum()
        return int(both + (only_a * f(a.p, b.p_zero)).sum() + (only_b * f(a.p_zero, b.p)).sum() + none * f(a.p_zero, b.p_zero))

    return of(_f), of(lambda p, q: _f(q, p))


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """All pairs of sources of two tiles (or within one) over one chunk: (gid, other, value).

    A source has one row for each of its terms and one with count 0 that carries the size of the chunk.
    """
    left, right = key[2].as_py(), key[3].as_py()
    cols = {c: rows.column(c).to_numpy() for c in ("gid", "tile", "n", "p", "bit")}
    order = np.argsort(cols["gid"], kind="stable")
    cols = {c: v[order] for c, v in cols.items()}
    gids, first = np.unique(cols["gid"], return_index=True)
    ends = np.r_[first[1:], len(order)]
    groups = []
    for gid, lo, hi in zip(gids.tolist(), first, ends):
        n, p, bit = (cols[c][lo:hi] for c in ("n", "p", "bit"))
        zero = np.flatnonzero(n == 0)[0]
        real = n > 0
        groups.append((gid, int(cols["tile"][lo]), int(bit[zero]), Levels(bit[real], n[real], p[real], p[zero])))
    out: list[list[int]] = [[], [], []]
    for i, (ga, ta, terms, a) in enumerate(groups):
        for gb, tb, _, b in groups[i + 1 :]:
            if left != right and ta == tb:
                continue  # they meet in the tile's own task
            there, back = divergences(a, b, terms)
            out[0] += [ga, gb]
            out[1] += [gb, ga]
            out[2] += [there, back]
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["gid", "other", "value"])


# ---- the audit


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """Divergence of every source from the others of its language, and its own overused terms.

    (lang, source, part, item, value, rank). ``pair``: item is another source of the language,
    value the sum of f over the language's kept terms. ``term``: item is a kept term that the
    source uses more than the language does, value its f, the first ``top`` by value.

    A null text, lang or source counts as empty; an empty text gives its (lang, source) without
    terms, whose pairs still count. Terms of fewer than ``min_docs`` rows of a language are
    left out; repeated rows count once each. Equal values rank by item in UTF-8. An empty table
    gives no rows. Other columns are not read.

    Terms never gather at one task: counts are added up before each shuffle, numbers come
    from a range partitioning, and a task holds one chunk of ``chunk`` terms and about two tiles of ``tile`` sources.
    """
    counts = cut(term_counts(docs))
    vocabulary = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    vocabulary = vocabulary.where(F.col("docs") >= min_docs).select("lang", "term", "in_lang", F.struct((-F.col("in_lang")).alias("n"), "term").alias("place"))
    numbered = prefix_scan(vocabulary, ["lang"], "place", sums={"id": F.lit(1)}).drop("place")
    kept = cut(counts.drop("docs").join(numbered, ["lang", "term"]))

    langs = kept.groupBy("lang").agg(F.max("id").alias("last"), F.sum("n").alias("lang_total"))
    langs = cut(langs.select("lang", (F.col("last") + 1).alias("terms"), "lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left")
    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    groups = groups.join(sources, "lang").join(langs, "lang", "left").select(
        "lang", "source", "tiles", F.pmod(F.xxhash64("source"), "tiles").alias("tile"), "terms", "lang_total",
        (F.coalesce("total", F.lit(0)) + F.col("terms")).alias("total"),
    )
    groups = cut(groups).withColumn("gid", F.monotonically_increasing_id())  # of a stored table: the same at each reading
    groups = cut(groups)
    small = is_small(groups)

    def of_group(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(groups) if small else groups, ["lang", "source"])

    rows = of_group(kept.drop("in_lang", "term"))
    bits = rows.select("lang", "gid", "tile", "tiles", F.expr(f"id div {chunk}").alias("chunk"), "n", probability("n", "total").alias("p"), (F.col("id") % chunk).alias("bit"))
    # each source in each chunk: its probability of a term it lacks, and how many terms the chunk has
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(terms - 1) div {chunk}"))).alias("chunk")
    zeros = groups.where("terms > 0").select("lang", "gid", "tile", "tiles", "terms", "total", every)
    zeros = zeros.select(
        "lang", "gid", "tile", "tiles", "chunk", F.lit(0).cast("long").alias("n"), probability("cast(0 as bigint)", "total").alias("p"),
        F.least(F.lit(chunk), F.col("terms") - F.col("chunk") * chunk).cast("long").alias("bit"),
    )
    met = bits.unionByName(zeros).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.select("lang", "chunk", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "gid", "tile", "n", "p", "bit")
    partial = met.groupBy("lang", "chunk", "a", "b").applyInArrow(_tile, "gid long, other long, value long")
    sums = partial.groupBy("gid", "other").agg(F.sum("value").alias("value"))
    # every pair is a row of the result, so the pairs are no more than that
    names = groups.select("lang", "source", "gid", "terms")
    others = names.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"))
    pairs = names.join(others, "lang").where(F.col("gid") != F.col("other")).join(sums, ["gid", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    terms = of_group(kept).select("lang", "source", F.col("term").alias("item"), probability("n", "total").alias("p"), probability("in_lang", "(lang_total + terms)").alias("q"))
    terms = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", excess("p", "q").alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
