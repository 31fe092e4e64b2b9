"""Packing of documents into fixed token windows by non-negative least squares.

Each block of documents (bounded tokens, one task) is packed by itself, so nothing is shuffled and any number of blocks can be
packed at once. In a block, whole windows are cut from long documents first. The lengths that remain form a histogram over
bins of UNIT tokens. Every combination of up to DEPTH bins that fills a window is a column; non-negative least squares finds
how often each combination repeats so that together they use up the histogram. The repeats are rounded down and filled with
documents. What is left over is poured greedily into the gaps, cut where needed, so that full sequences have no padding; a
block's tail goes into sequences whose lengths are powers of two, which need no padding either.

Defined cases: null and empty texts are the end id alone; repeated rows are packed once each; an empty table gives an empty
result; extra columns are not read; a document longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import byte_slices, read_table
from riskloom.llm.wordbpe import encoder, vocabulary_path

WINDOW, UNIT, DEPTH, END_ID = 4096, 64, 4, 2
BLOCK_TOKENS = 4_000_000
ENCODED_BYTES = 4 << 20  # of texts encoded at once

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(present: list[int], total: int, depth: int) -> list[tuple[int, ...]]:
    """Ascending tuples of up to depth of the present bin sizes that add up to total."""
    found, sizes = [], set(present)

    def extend(parts: tuple[int, ...], rest: int) -> None:
        least = parts[-1] if parts else 1
        if rest in sizes and rest >= least:
            found.append((*parts, rest))
        if len(parts) + 1 < depth:
            for size in present:
                if size >= least and rest - size >= size:
                    extend((*parts, size), rest - size)

    extend((), total)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 that makes |ax - b| least, by active sets: the column with the steepest descent joins, and those that would turn negative leave."""
    m, n = a.shape
    x, active, tried = np.zeros(n), np.zeros(n, bool), 0
    while tried < rounds:
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if n == 0 or active.sum() >= m or gain.max() <= 1e-7:
            break
        active[int(gain.argmax())] = True
        while tried < rounds:
            tried += 1
            index = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, index], b, rcond=None)[0]
            if s.size == 0 or s.min() > 1e-10:
                x[:] = 0
                x[index] = s
                break
            low = s <= 1e-10
            step = min(1.0, float((x[index][low] / np.maximum(x[index][low] - s[low], 1e-12)).min()))
            x[index] += step * (s - x[index])
            active[index[x[index] <= 1e-10]] = False
            x[~active] = 0
    return x


def plan_block(lengths: list[int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0. All but the tail's sequences are full."""
    pieces, sequence, bins = [], 0, defaultdict(list)
    for doc, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((doc, k * window, window, sequence, 0))
            sequence += 1
        if n % window:
            bins[-(-(n % window) // unit)].append((doc, n - n % window, n % window))
    present = sorted(bins)
    columns = combinations(present, window // unit, depth)
    a = np.zeros((len(present), len(columns)))
    row = {size: i for i, size in enumerate(present)}
    for j, parts in enumerate(columns):
        for size in parts:
            a[row[size], j] += 1
    groups: list[list[tuple[int, int, int]]] = []
    if columns:
        x = np.floor(nnls(a, np.array([float(len(bins[s])) for s in present])) + 1e-6).astype(int)
        for j in np.argsort(-x, kind="stable"):
            for _ in range(x[j]):
                if all(len(bins[s]) >= columns[j].count(s) for s in columns[j]):
                    groups.append([bins[s].pop() for s in columns[j]])
    rest = sorted((item for items in bins.values() for item in items), key=lambda item: (-item[2], item[0]))
    total = sum(length for group in groups for *_, length in group) + sum(length for *_, length in rest)
    groups.sort(key=lambda group: -sum(length for *_, length in group))
    keep = total // window
    for group in groups[keep:]:
        rest += group
    groups = groups[:keep] + [[] for _ in range(keep - len(groups))]
    rest.reverse()  # the longest are taken first, from the end
    for group in groups:
        offset = 0
        for doc, start, length in group:
            pieces.append((doc, start, length, sequence, offset))
            offset += length
        while offset < window:
            doc, start, length = rest.pop()
            part = min(length, window - offset)
            pieces.append((doc, start, part, sequence, offset))
            offset += part
            if part < length:
                rest.append((doc, start + part, length - part))
        sequence += 1
    tail = total % window
    while tail:
        size = 1 << (tail.bit_length() - 1)
        offset, tail = 0, tail - size
        while offset < size:
            doc, start, length = rest.pop()
            part = min(length, size - offset)
            pieces.append((doc, start, part, sequence, offset))
            offset += part
            if part < length:
                rest.append((doc, start + part, length - part))
        sequence += 1
    return pieces


def _pack(path: str, window: int, end_id: int, block_tokens: int):
    def block(ids: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(t) for t in tokens]
        pieces = plan_block(lengths, window)
        crcs = [zlib.crc32(tokens[d][s : s + n]) for d, s, n, _, _ in pieces]
        doc, start, length, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
        arrays = [pa.array(ids, pa.int64()).take(pa.array(doc)), *map(pa.array, (start, length, np.array(crcs, np.int64), np.array(lengths, np.int64)[doc], first + sequence, offset))]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in RESULT.split(", ")]), first + int(sequence[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_texts
        first, ids, tokens, held = TaskContext.get().partitionId() << 40, [], [], 0
        for part in byte_slices(batches, 1, ENCODED_BYTES):
            flat, begins = encode(part.column(1), end_id)
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                ids.append(doc_id)
                tokens.append(flat[begins[k] : begins[k + 1]])
                held += len(tokens[-1])
                if held >= block_tokens:
                    out, first = block(ids, tokens, first)
                    ids, tokens, held = [], [], 0
                    yield out
        if ids:
            yield block(ids, tokens, first)[0]

    return run


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. The high bits of sequence_id number the task, so ids are unique without a shuffle."""
    path = path or vocabulary_path()
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pack(path, window, end_id, block_tokens), RESULT)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
