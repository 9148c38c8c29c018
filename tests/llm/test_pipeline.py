"""The corpus pipeline on the smallest tables, each stage against a plain version of its decision."""

import math
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from flowengine.llm import sentencepiece_viterbi, simhash_vptree

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_plain_versions(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
    every = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    # labels that a classifier learnt from are mostly kept as they say
    right = [(d in kept[0]) == (labels[d].quality == 1) for d in labels]
    assert np.mean(right) > 0.95
    # near duplicates: the smallest id of each group of linked fingerprints
    ids = sorted(kept[1])
    f = simhash_vptree.simhashes(pa.array([every[i] for i in ids]))
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    low = np.arange(len(ids))
    while (new := np.array([low[close[i]].min() for i in range(len(ids))])).tolist() != low.tolist():
        low = new
    assert sorted(kept[2]) == sorted({ids[i] for i in low})
    # benchmark passages
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {d for d in kept[2] if any(len(s & shingles(every[d])) >= math.ceil(0.8 * len(s)) for s in items if s)}
    assert set(kept[3]) == set(kept[2]) - bad
    p = sentencepiece_viterbi.Pieces(sentencepiece_viterbi.read_pieces(sentencepiece_viterbi.MODEL))
    assert set(kept[4]) == set(kept[3])
    for d, r in kept[4].items():
        assert r.exact and r.ids == p.encode(every[d])
    again = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()}
    assert again == {d: r.ids for d, r in kept[4].items()}
