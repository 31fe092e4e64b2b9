"""Texts with a Jaccard similarity of 0.8 or more over their sets of five-word shingles, by wide SimHash fingerprints.

Each text has a fingerprint of WORDS x 64 bits: a bit is set if it is set in over half the hashes of the text's distinct
shingles. Two texts of similarity s differ in each bit with a chance of about acos(2 s / (1 + s)) / pi. Tables of keys are made
of bits drawn from the fingerprint: as many bits a key as tell all texts apart (by their number), and as many tables as find a
pair of the least similarity with a chance of RECALL. Pairs above it are found more surely. That chance is the one loss; it is a
parameter and the same at every size.

In every bucket of equal keys the least row leads: the others are paired with it if a word of both fingerprints and the sizes of
their sets allow it, and those that it doesn't allow form a bucket again. So a group of n near copies gives at most n pairs a
table. All pairs are then verified by the exact similarity of the whole texts.

Defined cases: null texts count as empty; texts of fewer than five words have one shingle, their words; texts without words are
all alike; an empty table gives no pairs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import byte_slices, saved

SHINGLE, SIMILAR, RECALL = 5, 0.8, 0.95
WORDS, SPARE_BITS, LIKELY_BITS = 8, 2, 20
BLOCK_BYTES = 2 << 20
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Of each byte its bits, one in each byte of a number, so that up to 255 of them are added at once.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt * int(MIX[2]) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, each text's count of words); A-Z are lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.array([w != "" for w in coded.dictionary.to_pylist()], bool)
    keep = filled[index] if len(index) else np.zeros(0, bool)  # white space at a text's ends
    counts = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets))[keep], minlength=len(texts))
    return hashes[index[keep]] if len(index) else np.zeros(0, np.uint64), counts


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in turn, each text's number of them)."""
    n = np.maximum(counts - size + 1, 1)
    begins, text = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), n)
    at = begins[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.append(words, np.zeros(size, np.uint64))
    found = np.zeros(len(text), np.uint64)
    for k in range(size):
        inside = at + k < (begins + counts)[text]
        found = found * MIX[2] + np.where(inside, padded[np.minimum(at + k, len(words))] | np.uint64(1), np.uint64(0))
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[fresh], np.bincount(text[fresh], minlength=len(counts))


def wide_prints(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of WORDS numbers for each text, whose shingles stand one after the other."""
    pieces = -(-sizes // 255)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    of_text = np.cumsum(pieces) - pieces
    prints = np.empty((len(sizes), WORDS), np.uint64)
    for w in range(WORDS):
        data = mixed(shingles, w + 1).view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(sizes), 8, 8), bool)
        for b in range(8):
            lanes = np.add.reduceat(LANES[data[:, b]], starts).view(np.uint8).reshape(-1, 8)
            bits[:, b] = 2 * np.add.reduceat(lanes.astype(np.int64), of_text) > sizes[:, None]
        prints[:, w] = np.packbits(bits.reshape(len(sizes), 64), axis=1).view(np.uint64).ravel()
    return prints


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, 1, BLOCK_BYTES):
        shingles, sizes = shingle_sets(*word_numbers(part.column(1)))
        prints = wide_prints(shingles, sizes).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(list(prints), pa.list_(pa.int64()))], ["row", "n", "fp"])


def table_plan(rows: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits a key, tables) for so many rows."""
    bits = min(48, math.ceil(math.log2(max(rows, 2))) + SPARE_BITS)
    same = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _keys(bits: int, tables: int):
    rnd = random.Random(5)
    chosen = [rnd.sample(range(64 * WORDS), bits) for _ in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                prints = part.column(2).flatten().to_numpy().reshape(-1, WORDS)
                flat = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)
                check = pa.array(np.ascontiguousarray(prints[:, 0]))
                for t, columns in enumerate(chosen):
                    key = mixed((flat[:, columns].astype(np.uint64) * power).sum(1, dtype=np.uint64), t + 1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), pa.array(part.column(1).to_numpy().astype(np.int32)), check], ["key", "row", "n", "bits"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, 2, BLOCK_BYTES):
            both = [np.split(*_cuts(*shingle_sets(*word_numbers(part.column(k))))) for k in (2, 3)]
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both, strict=True)])
            alike = shared >= least * (np.array([len(x) for x in both[0]]) + np.array([len(y) for y in both[1]]) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(alike))

    return run


def _cuts(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles, np.cumsum(sizes)[:-1]


def similar_pairs(rows: DataFrame, least: float = SIMILAR, more: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, that link all similar texts of rows (_row, text): each text of a bucket to its leader, not all to all. more: pairs
    (a, b), a < b, that were found otherwise and are verified with these."""
    prints = saved(rows.select("_row", "text").mapInArrow(_prints, "row long, n long, fp array<long>"), "wide-prints", compression="zstd")
    keyed = prints.mapInArrow(_keys(*table_plan(prints.count(), least)), "key long, row long, n int, bits long")
    found = more
    while True:
        lead = keyed.groupBy("key").agg(F.min(F.struct("row", "n", "bits")).alias("l"), F.count("*").alias("size")).where("size > 1").select("key", F.col("l.row").alias("a"), F.col("l.n").alias("an"), F.col("l.bits").alias("abits"))
        likely = (F.bit_count(F.col("bits").bitwiseXOR(F.col("abits"))) <= LIKELY_BITS) & (F.least("n", "an") >= least * F.greatest("n", "an") - 1e-9)
        led = saved(keyed.join(lead, "key").where("row <> a").select("key", "row", "n", "bits", "a", likely.alias("likely")), "led", compression="zstd")
        pairs = led.where("likely").select("a", F.col("row").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        keyed = led.where("not likely").select("key", "row", "n", "bits")
        if keyed.isEmpty():
            break
    found = saved(found.distinct(), "likely-pairs")
    texts = rows.select("_row", "text")
    of_a = found.join(texts.select(F.col("_row").alias("a"), F.col("text").alias("ta")), "a")
    of_both = of_a.join(texts.select(F.col("_row").alias("b"), F.col("text").alias("tb")), "b")
    return saved(of_both.select("a", "b", F.coalesce("ta", F.lit("")), F.coalesce("tb", F.lit(""))).mapInArrow(_verify(least), "a long, b long"), "similar-pairs")
