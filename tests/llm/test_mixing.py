"""Mixing of sources against a plain loop: water filling, keys, epochs and cuts; odd rows; skew over many partitions."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left, rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / rest for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def plain_mix(rows, quality=None):
    sized = []
    for k, (i, text, source) in enumerate(rows):
        size = len(WORD.findall(text or ""))
        u = (int(hashlib.md5(f"mix:{'' if i is None else i}:{text or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = quality[k] if quality else max(0.05, 1 - abs(len(text or "") / size - 6.5) / 10) if size else 0.05
        bad = w is None or not w > 0
        sized.append((i, source, size, (bad, 0.0 if bad else -math.log(u) / w, u)))
    of = {}
    for _, s, n, _ in sized:
        of[s] = of.get(s, 0) + n
    target, found = plain_targets(of), []
    for s, n in of.items():
        epochs = int(target[s] // n) if n else 0
        left = math.floor(target[s]) - epochs * n
        for i, _, size, _ in sorted((r for r in sized if r[1] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2])):
            cut = max(0, min(size, left))
            left -= cut
            found.append((i, size, n, round(target[s], 6), epochs * size + cut))
    return sorted(found, key=repr)


def sample():
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["a", "port", "harbour", "ünïcode", "42"]) for _ in range(n))
    rows = [(k, text(rnd.randint(1, 30)), rnd.choice(["b", "a", "z", "B", "é", "hot", "hot", "hot"])) for k in range(300)]
    return rows + [(400, None, "a"), (401, "", None), (402, text(40), None), (403, " \t\n", "empty"), (None, text(5), "a"), (None, None, None), (405, text(30_000), "long"), (7, "same row", "b"), (7, "same row", "b")]


def got_of(frame):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect()), key=repr)


def test_against_a_plain_loop(spark):
    rows = sample()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, _range string, size int")
    want = plain_mix(rows)
    assert got_of(mixing.mix_sources(frame.repartition(5))) == want
    assert got_of(mixing.mix_sources(frame.repartition(3, "source"))) == want  # another partitioning
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    told = sorted(((d, n, s, round(t, 6), k) for d, n, s, t, k in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP13_SQL})").fetchall()), key=repr)
    assert told == want
    for source, size in {r.source: r.source_size for r in mixing.mix_sources(frame).collect()}.items():
        taken = sum(r.taken for r in mixing.mix_sources(frame.where(F.col("source").eqNullSafe(source))).collect()) if source == "hot" else None
        assert taken is None or taken == math.floor(1.5 * size)


def test_weights_put_documents_first_or_last(spark):
    rows = [(k, "w " * 10, "s") for k in range(200)]
    quality = [100.0 if k < 50 else None if k < 60 else float("nan") if k < 70 else -1.0 if k < 80 else 0.01 for k in range(200)]
    frame = spark.createDataFrame([(*r, q) for r, q in zip(rows, quality, strict=True)], "doc_id long, text string, source string, q double")
    found = mixing.mix_sources(frame, quality=F.col("q"))
    assert got_of(found) == plain_mix(rows, quality)
    twice = {r.doc_id for r in found.collect() if r.taken == 20}
    assert len(twice) == 100 and set(range(50)) <= twice and not twice & set(range(50, 80))


def test_sampling_follows_weights(spark):
    """A document of four times the weight is drawn first four times as often: 1000 pairs, each a source of its own."""
    rows = [(2 * k + j, "a b", f"s{k}", 4.0 if j else 1.0) for k in range(1000) for j in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    heavy = mixing.mix_sources(frame, quality=F.col("q"), weights=(1,)).where("taken = 4 and doc_id % 2 = 1").count()
    assert 740 < heavy < 860


def test_texts_of_the_mix(spark):
    frame = spark.createDataFrame([(1, "a b  c d", "s"), (2, "e f g", "s"), (3, "", "s"), (4, None, None)], "doc_id long, text string, source string")
    taken = mixing.mix_sources(frame)
    texts = mixing.mixed_texts(frame, taken).collect()
    assert sum(r.n_words for r in texts) == sum(r.taken for r in taken.collect()) == 10
    assert all(len(r.text.split()) == r.n_words for r in texts) and {r.text for r in texts if r.epoch == 0} == {"a b  c d", "e f g"}
    again = [r for r in texts if r.epoch == 1]
    assert sum(r.n_words for r in again) == 3 and all(("a b  c d" if r.doc_id == 1 else "e f g").split()[: r.n_words] == r.text.split() for r in again)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "s"), (2, None, "t")]])
def test_tables_without_words(spark, rows):
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == len(rows) and all(r.taken == 0 and r.target == 0 for r in found)
