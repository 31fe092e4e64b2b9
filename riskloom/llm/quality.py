"""Quality rules: base counts of a text, and line labels by a linear-chain conditional random field.

Each line of a text is one item of a sequence with features of its length, symbols, capitals, digits, repetition, ending and
opening words. Viterbi decoding marks it as content or boilerplate; the share of the text's word characters that lie in content
lines decides whether the document stays, unless the base rules fail it.

The field is trained on the lines of at most max_rows labelled documents outside the held-out fold (a bound on the fit alone).
Documents that the base rules fail tell nothing about lines and are left out. Lines are labelled one by one: boilerplate are those that recur over the corpus, that is, stand between at least RECURS different
pairs of neighbours in all documents (whole copies of a document have the same neighbours, so they don't count), and all lines
of a document of quality 0. Other lines of a document of quality 1 are
content, so labels change within a text. Long texts are trained on in runs of RUN lines, none of which is left out.

Defined cases: null and empty texts have no words, so the base rules fail them; null labels are left out, and of several
labels of one doc_id the largest counts, of several texts of one doc_id the least; repeated rows get a row each; without training rows every line counts as content; an
empty table gives an empty result; extra columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import id_text, read_table, text_batches
from riskloom.llm.crf import LinearChain, train, viterbi

# The base rules.
SYMBOLS = "#*$%&|<>"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

MAX_ROWS, RUN, RECURS = 800, 200, 3
FOLDS, HELD_OUT = 5, 1
MIN_CONTENT_SHARE = 0.4
NOT_SYMBOLS = re.compile(f"[^{re.escape(SYMBOLS)}]+")
OPENINGS = 64  # hashes of a line's first two words
SHAPES = 15
FEATURES = SHAPES + OPENINGS
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def words_of(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that are found twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    n = end = 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def line_features(lines: list[str]) -> tuple[np.ndarray, list[int]]:
    """A feature row per line, and the line's characters in words."""
    rows, sizes, seen = np.zeros((len(lines), FEATURES)), [], set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        size = len("".join(words))
        sizes.append(size)
        if not n:
            rows[i, 0] = rows[i, 1] = 1
            continue
        symbols = size and len(NOT_SYMBOLS.sub("", line)) / size
        capitals, digits = sum(map(str.isupper, words)) / n, sum(map(str.isdigit, line)) / size
        last, repeats, loud = words[-1][-1], 1 - len(set(words)) / n > 0.5, line.count("!") / n > 0.3
        rows[i, :SHAPES] = (1, 0, symbols > 0.02, min(symbols, 0.3) * 3, capitals > 0.5, loud, min(digits, 0.3) * 3, line in seen, n < 5, n > 15, last in ".?", repeats, size / n > 12, not line[:1].isupper(), n > 4 and symbols <= 0.02 and capitals <= 0.5 and not repeats and not loud)
        rows[i, SHAPES + zlib.crc32(" ".join(words[:2]).encode()) % OPENINGS] = 1
        seen.add(line)
    return rows, sizes


def content_share(model: LinearChain | None, text: str) -> float:
    lines = text.split("\n")
    features, sizes = line_features(lines)
    total = sum(sizes)
    if not total:
        return 0.0
    if model is None:
        return 1.0
    return sum(size for size, label in zip(sizes, viterbi(model, features), strict=True) if label == 0) / total


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    n = len(words)
    return n, sum(map(len, words)), len(NOT_SYMBOLS.sub("", text)), dup, repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n


def _judge(model: LinearChain | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            counts = [base_counts(t) for t in texts]
            shares = [content_share(model, t) for t in texts]
            kept = [not c[5] and s >= MIN_CONTENT_SHARE for c, s in zip(counts, shares, strict=True)]
            columns = [pa.array([c[k] for c in counts], pa.int64() if k < 5 else pa.bool_()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(kept, pa.bool_()), pa.array(shares, pa.float64())], [f.split()[0] for f in RESULT.split(", ")])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(id_text(id_col)) % FOLDS == HELD_OUT


def recurring_lines(docs: DataFrame, lines: DataFrame, text_col: str = "text", least: int = RECURS) -> DataFrame:
    """The rows of lines (column line, distinct) that stand between at least so many different pairs of neighbours in docs."""
    split = docs.select(F.split(F.col(text_col).cast("string"), "\n").alias("l")).select(F.explode(F.expr("transform(l, (x, i) -> struct(x AS line, xxhash64(get(l, i - 1), get(l, i + 1)) AS around))")).alias("e")).select("e.*")
    return split.join(F.broadcast(lines), "line").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line")


def line_labels(lines: list[str], quality: int, recurring: set[str]) -> np.ndarray:
    return np.array([quality == 0 or line in recurring for line in lines], np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LinearChain | None:
    """Trains on the lines of at most max_rows labelled documents, half of either label where there are as many. The texts of these come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_label = 1").orderBy(*order).limit(max_rows // 2).unionByName(known.where("_label = 0").orderBy(*order).limit(max_rows // 2))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    found = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).orderBy("_id").toArrow().to_pylist()
    found = [r for r in found if not base_counts(r["_text"] or "")[5]]
    if {r["_label"] for r in found} < {0, 1}:
        return None
    texts = [(r["_text"] or "").split("\n") for r in found]
    lines = sorted({line for text, r in zip(texts, found, strict=True) if r["_label"] for line in text if line.strip(SPACE)})
    sent = docs.sparkSession.createDataFrame(pa.table({"line": pa.array(lines, pa.string())}))
    recurring = set(recurring_lines(docs, sent, text_col).toPandas()["line"])
    sequences, targets = [], []
    for text, r in zip(texts, found, strict=True):
        features, target = line_features(text)[0], line_labels(text, r["_label"], recurring)
        for at in range(0, len(text), RUN):
            sequences.append(features[at : at + RUN])
            targets.append(target[at : at + RUN])
    return train(sequences, targets, rounds=160)


def judge_quality(docs: DataFrame, model: LinearChain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_judge(model), RESULT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge_quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
