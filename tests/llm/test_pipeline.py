"""The pipeline against a plain version of each of its decisions."""

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluiceway.llm import language, quality

from test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, SF)
        rows = kept.collect()
        seen[name] = (before, rows)
        if name != "packing":
            assert kept.columns == columns
            kept = spark.createDataFrame(rows, docs.schema)
    before, rows = seen["language_id"]
    model = language.learn(docs)
    want = {i for i, (lang, share, _) in zip(before, language.Labeller(model).label(list(before.values()))) if lang != "und" and share >= corpus_pipeline.LANGUAGE_SHARE}
    assert {r.doc_id for r in rows} == want
    before, rows = seen["quality_classifier"]
    net = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.Scorer(net).scores([t.encode() for t in before.values()])
    assert {r.doc_id for r in rows} == {i for i, s in zip(before, scores) if s >= quality.THRESHOLD}
    before, rows = seen["exact_dedup"]
    groups = {}
    for i, t in before.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    assert {r.doc_id for r in rows} == {min(g)[1] for g in groups.values()}
    before, rows = seen["ngram_jaccard_join"]
    assert {r.doc_id for r in rows} == {c for _, c in brute_components(before.items()).values()}
    before, rows = seen["packing"]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    held = {}
    for r in rows:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}
    used = len({r.sequence_id for r in rows})
    assert used <= 1 + 1.05 * np.ceil(sum(held.values()) / 1024)


def test_run(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_stages_with_odd_rows_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = ("__score", "__text", "__lang_pred", "__digest", "__bytes", "__id")
    text = docs.first().text
    odd = [(None, None), (9_000_001, None), (9_000_002, ""), (None, text), (9_000_003, text), (9_000_003, text), (9_000_004, (text + " ") * 400)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    for name in extra:
        table = table.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        rows = out.collect()
        assert out.columns == table.columns and rows, name
        assert all(r[c] == c for r in rows for c in extra), name
        assert stage(spark, table.limit(0), SF).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, table, SF).where("doc_id = 9000002").count() == 1
    assert stage(spark, table.limit(0), SF).count() == 0
