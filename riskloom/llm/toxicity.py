"""Toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased words and their first 2 to 7 letters, each hashed into BUCKETS. The model keeps the
buckets that tell the labels apart best on the training rows, and gives each a weight and a vector of RANK factors: a document
scores sigmoid(b + sum of weights + sum over pairs of buckets present of the product of their vectors), so that a pair, such
as an insult beside a group's name, counts beyond the two by themselves.

The training rows are labelled rows outside the held-out fold; where there are more than max_rows, those with the least hash of
doc_id are taken (a bound on the fit alone; every document is scored). Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have no terms and score sigmoid(b); null labels are left out, and of several labels of one
doc_id the largest counts; repeated rows get a row each; without a training row of either label every score is the rate of the
labels there are (0 without any); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import id_text, read_table, text_batches

BUCKETS, PREFIXES = 1 << 20, range(2, 8)
MAX_ROWS, KEPT, RANK = 6000, 2000, 4
LEAST_GAIN = 8.0  # nats of G below which a term tells nothing
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
WORD = re.compile(r"[^\W_]+")
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(id_text(id_col)) % FOLDS == HELD_OUT


def word_buckets(word: str) -> tuple[int, ...]:
    terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return tuple({zlib.crc32(t.encode()) % BUCKETS for t in terms})


def text_buckets(text: str) -> set[int]:
    return {b for word in set(WORD.findall(text.lower())) for b in word_buckets(word)}


@dataclass
class FactorizationMachine:
    buckets: np.ndarray
    bias: float = -30.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """x: documents by kept buckets, 0 or 1."""
        together = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * (together**2 - x @ self.factors**2).sum(1)


def train(rows: list[np.ndarray], labels: np.ndarray, kept: int = KEPT, rank: int = RANK, rounds: int = 200, decay: float = 2e-3) -> FactorizationMachine:
    """Fits the machine to documents' buckets by Adam on the logistic loss; factors start small and random, weights at nought."""
    y = labels.astype(np.float32)
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < rate < 1:
        return FactorizationMachine(np.zeros(0, np.int64), -30.0 if rate == 0 else 30.0)
    counts, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for row, label in zip(rows, y, strict=True):  # row by row, so that the driver holds no second copy of the buckets
        np.add.at(counts, row, 1)
        np.add.at(toxic, row, label)
    n, p = len(y), y.sum()
    often = np.flatnonzero(counts >= 3)
    a, counts = toxic[often], counts[often]
    b, c, d = counts - a, p - a, (n - p) - (counts - a)
    gain = sum(x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)) for x, e in ((a, counts * p / n), (b, counts * (n - p) / n), (c, (n - counts) * p / n), (d, (n - counts) * (n - p) / n)))
    first = np.sort(np.argsort(-gain, kind="stable")[:kept])
    best = often[first[gain[first] > LEAST_GAIN]]
    place = np.full(BUCKETS, -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    for i, row in enumerate(rows):
        at = place[row]
        x[i, at[at >= 0]] = 1
    sloped = np.empty_like(x)
    random = np.random.default_rng(7)
    machine = FactorizationMachine(best, float(np.log(rate / (1 - rate))), np.zeros(len(best), np.float32), random.normal(0, 0.01, (len(best), rank)).astype(np.float32))
    state = [np.zeros(1), machine.weights, machine.factors]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for step in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(machine.margin(x), -60, 60))) - y) / n
        together = x @ machine.factors
        slope = np.multiply(x, error[:, None], out=sloped).T
        gradient = [np.array([error.sum()]), slope @ np.ones(n, np.float32) + decay * machine.weights / 10, slope @ together - (x.T @ error)[:, None] * machine.factors + decay * machine.factors]
        moves = []
        for i, g in enumerate(gradient):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            moves.append(0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8))
        machine.bias -= float(moves[0][0])
        machine.weights = (machine.weights - moves[1]).astype(np.float32)
        machine.factors = (machine.factors - moves[2]).astype(np.float32)
    return machine


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([labels, pa.array([sorted(text_buckets(t)) for t in texts], pa.list_(pa.int32()))], ["label", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Trains on at most max_rows labelled rows outside the held-out fold. Only their buckets come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    one = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # of several texts of a doc_id the least
    found = one.select("_label", "_text").mapInArrow(_buckets_of, "label int, buckets array<int>").toArrow()
    label, lists = found["label"].to_numpy(), found["buckets"].combine_chunks()
    del found  # the lists stand in one piece now
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = sorted(range(len(at) - 1), key=lambda i: flat[at[i] : at[i + 1]].tobytes())  # the fit doesn't depend on the order of arrival
    return train([flat[at[i] : at[i + 1]] for i in order], label[order])


def _score(machine: FactorizationMachine):
    kept = {int(b): i for i, b in enumerate(machine.buckets)}
    seen: dict[str, tuple[int, ...]] = {}

    def places(word: str) -> tuple[int, ...]:
        found = seen.get(word)
        if found is None:
            found = tuple(kept[b] for b in word_buckets(word) if b in kept)
            if len(seen) < 300_000:
                seen[word] = found
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            margins = np.full(len(texts), machine.bias)
            for i, text in enumerate(texts):
                at = list({p for word in set(WORD.findall(text.lower())) for p in places(word)})
                if at:
                    v = machine.factors[at]
                    margins[i] += machine.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
            scores = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string")).mapInArrow(_score(machine), RESULT)


def _keep(machine: FactorizationMachine, position: int):
    score = _score(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.nulls(batch.num_rows, pa.int64())
            part = pa.RecordBatch.from_arrays([n, n, batch.column(position)], ["a", "b", "c"])
            for found in score(iter([part])):
                yield batch.filter(pa.compute.equal(found.column(3), 0))

    return run


def drop_toxic(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the machine doesn't predict to be toxic."""
    return docs.mapInArrow(_keep(machine, docs.columns.index(text_col)), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
