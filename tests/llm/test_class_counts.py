"""Counts of words by the class of a text: what travels to each task changes no score."""

import zlib

import pytest

from riskloom.llm import context_mixing as M


@pytest.mark.parametrize("sent", [(6, 2), (0, 0), (40, 1)])
def test_every_word_is_counted_by_class(spark, monkeypatch, sent):
    # "la" and "the" make two classes, and most words stand in both, unevenly
    rows = [(k, f"{'la la la' if k % 3 else 'the the the'} word{k % 11} word{k % 7} other{k % 5} thing{k * k % 13}") for k in range(120)] + [(500, None), (501, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    assert zlib.crc32(b"la") % M.CLASSES != zlib.crc32(b"the") % M.CLASSES
    whole = {r.doc_id: r.score for r in M.score_texts(docs).collect()}
    monkeypatch.setattr(M, "FREQUENT", sent[0])
    monkeypatch.setattr(M, "CLASSED", sent[1])
    found = {r.doc_id: r.score for r in M.score_texts(docs).collect()}
    assert len(whole) == 122 and found == pytest.approx(whole, rel=1e-6)
