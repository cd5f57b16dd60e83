import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from sparrowdex.llm import common, decontaminate, simhash, token_store


def test_pipeline_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        docs, _ = common.keep_written(out, "test")
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    good, dedup, clean, mixed = kept.values()
    assert sum(labels[i] for i, _ in good if i in labels) > 0.9 * sum(labels.values()) and sum(labels[i] == 0 for i, _ in good if i in labels) <= 1
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in dedup}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            assert len(sets[i] & sets[j]) < 0.8 * max(len(sets[i] | sets[j]), 1)
    items = [r["text"] for r in common.table(spark, sf, "benchmark").collect()]
    assert not any(x in t for _, t in clean for x in items)
    assert {i for i, _ in mixed} == {i for i, _ in clean}
    rows = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), key=lambda r: r["start"])
    library, texts, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), dict(mixed), 0
    for r in rows:
        own = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(rows) == len(mixed) and decontaminate.leaks(docs, common.table(spark, sf, "benchmark")).count() == 0


def test_dedup_keeps_rows_with_null_and_repeated_ids(spark, sf):
    text = lambda n: " ".join(f"{n}w{k}" for k in range(50))
    rows = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (None, text("a")), (2, text("a")), (1, text("a")), (None, text("d")), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    out = corpus_pipeline.dedup_stage(spark, docs, sf)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (3, None)], key=str)


def test_workers_drop_what_other_stages_kept(spark, sf):
    def begin(module):
        def work(batches):
            yield from batches

        work.__module__ = module
        return list(common.tidy(work)(iter([1])))

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    kept = token_store.encoder(vocabulary)
    assert begin(token_store.__name__) == [1] and token_store.encoder(vocabulary) is kept
    assert begin(simhash.__name__) == [1] and token_store.encoder(vocabulary) is not kept

    # in worker processes too, where ``tidy`` comes pickled
    other = common.tidy(lambda batches: batches)

    def worker(batches):
        own = token_store.encoder(vocabulary)
        for batch in other(batches):
            yield pa.RecordBatch.from_arrays([pa.array([token_store.encoder(vocabulary) is not own] * batch.num_rows)], ["dropped"])

    dropped = [r["dropped"] for r in spark.range(4).mapInArrow(worker, "dropped boolean").collect()]
    assert len(dropped) == 4 and all(dropped)
