"""Steps of the named methods that work on all rows: the first weights of op3, the pivot tables of the pipeline's near stage."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from riskloom.llm import context_mixing as M
from riskloom.llm import simhash
from riskloom.llm.common import read_table


def test_all_words_teach_the_first_weights(spark):
    n = 300_500  # more than were once taken
    words = spark.range(n).select(M.F.concat(M.F.lit("w"), "id").alias("word"))
    table = spark.sparkContext.broadcast(np.zeros(2 * M.STARTS[-1], np.float32) + 2)
    blocks = M.block_weights(words, table, n).select("seen").collect()
    assert sum(r.seen for r in blocks) == n and max(r.seen for r in blocks) < 2 * M.LEARN_BLOCK


def test_bit_counts_take_little_memory(monkeypatch):
    monkeypatch.setattr(M, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Of", (), {"partitionId": lambda self: 0})())}))
    words = pa.array([f"word{k:09d}" for k in range(30_000)])
    tracemalloc.start()
    total = sum(sum(batch.column(2)[0].as_py()) for batch in M._bit_counts(iter([pa.RecordBatch.from_arrays([words], ["word"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 30_000 * 14 * 8 * len(M.ORDER_BITS)  # every bit of every byte and terminator, in each context
    assert peak < 150 << 20


def test_pivot_tables_find_near_copies(spark, sf_dir, monkeypatch):
    seen = []
    found = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda fps: seen.append(fps.columns) or found(fps))
    docs = read_table(spark, sf_dir, "documents")
    assert 0 < corpus_pipeline.near_stage(spark, docs, sf_dir).count() < docs.count()
    assert seen == [["fp"]]
    texts = docs.selectExpr("monotonically_increasing_id() AS _row", "text")
    pairs = simhash.fingerprint_pairs(texts).collect()
    assert pairs and all(p.a < p.b for p in pairs)
