"""The pipeline's stages against plain versions, each on its own input, over the smallest tables."""

import re

import pytest
from test_operators import five_word_sets, library_ids, plain_fingerprint  # noqa: F401

import corpus_pipeline
from riskloom.llm import secrets, toxicity
from riskloom.llm.common import read_table, saved


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, found = read_table(spark, sf_dir, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, sf_dir), "stage")
        found.append((docs, after))
        docs = after
    return found


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_toxicity(spark, sf_dir, steps):
    for before, after in steps[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS
    before, after = steps[0]
    scores = {r.doc_id: r.score for r in toxicity.op2_toxicity(spark, sf_dir).collect()}
    assert set(rows(after)) == {i for i in rows(before) if scores[i] < toxicity.THRESHOLD}


def test_exact_copies(steps):
    before, after = steps[1]
    keep = {}
    for r in before.collect():
        text = (r.text or "").encode().lower()
        keep[text] = max(keep.get(text, -1), r.doc_id)
    assert set(rows(after)) == set(keep.values())


def test_near_copies(steps):
    before, after = (rows(f) for f in steps[2])
    sets = {i: five_word_sets(r.text) for i, r in before.items()}
    ids = sorted(sets)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in alike:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert set(after) == {find(i) for i in ids}


def test_secrets_and_packing(steps):
    before, after = (rows(f) for f in steps[3])
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.text == (before[i].text and secrets.redact(before[i].text)) and (r.text is None or r.n_chars == len(r.text)) and not re.search("AKIA[A-Z0-9]{16}", r.text or "")
    pieces = steps[4][1].collect()
    length = {}
    for p in pieces:
        length[p.doc_id] = length.get(p.doc_id, 0) + p.length
    assert length == {i: len(library_ids(r.text, 2)) for i, r in after.items()}


def test_empty_tables_nulls_and_clashing_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x"), (-5, "", "en", "s", 0, 2, None), (-5, "", "en", "s", 0, 2, None)], "doc_id long, text string, lang string, source string, n_chars long, _row long, ids string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        assert stage(spark, odd, sf_dir).count() >= 1, name
