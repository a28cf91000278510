"""The corpus pipeline on a small table with every kind of document in it."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from llm_brute import cut_words, edits, near_duplicates


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert 0 < docs.count() <= left
        left = docs.count()
    assert docs.columns == ["doc_id", "n_pieces", "ids", "text_sha256"]
    assert all(r["n_pieces"] == len(r["ids"]) for r in docs.collect())
    benchmark = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    cleaned = spark.read.parquet(str(tmp_path / "3")).collect()
    digests = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cleaned}
    assert {r["doc_id"]: r["text_sha256"] for r in docs.collect()} == digests
    assert not any(b in r["text"] for r in cleaned for b in benchmark)
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned)


def test_stages_keep_odd_rows(spark, docs):
    """Null and empty texts, null ids and columns of other names go through the stages that take documents out."""
    folder = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        if stage is corpus_pipeline.quality:
            assert all(r["kept"] == "own kept" for r in rows)
            continue
        assert any(r["text"] is None and r["doc_id"] == 12 for r in rows) and any(r["doc_id"] is None for r in rows)
        assert all(r["kept"] == "own kept" for r in rows)
    tokens = corpus_pipeline.encode(spark, docs, folder).collect()
    texts = sorted((r["doc_id"] or -1, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["text_sha256"]) for r in tokens) == texts


def test_stages_against_brute_force(spark, corpus, tmp_path):
    """Near-dedup, substring dedup and decontamination on what the stage before kept, with every pair and window looked at."""
    rows = [r for r in corpus if len(r[1] or "") < 5000]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    stays = {(i, n) for n, (i, _, _, k) in enumerate(near_duplicates(rows, 5, 80)) if k or i is None}
    want = [rows[n] for _, n in stays]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)
    cut = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(want, "doc_id bigint, text string"), "").collect()
    after = [(i, t if not gone else left) for (i, t), (_, _, gone, left) in zip(want, cut_words(want, 35), strict=True)]
    assert sorted(((r[0], " ".join((r[1] or "").split())) for r in cut), key=repr) == sorted(((i, " ".join((t or "").split())) for i, t in after), key=repr)
    item = " ".join(max((t or "" for _, t in after), key=lambda t: len(t.split())).split()[:12])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontaminate(spark, spark.createDataFrame(after, "doc_id bigint, text string"), str(tmp_path)).collect()
    plain = " ".join(item.lower().split()).encode()
    free = [(i, t) for i, t in after if edits(plain, " ".join((t or "").lower().split()).encode()) > int(0.08 * len(plain))]
    assert 0 < len(free) < len(after) and sorted(map(tuple, clean), key=repr) == sorted(free, key=repr)


def test_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.count() == 0
