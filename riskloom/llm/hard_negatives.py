"""Hard negatives by a cover tree over norm-augmented candidates.

Candidates are dealt out to shards by a hash, and anchors to chunks; every chunk meets every shard once, in a stream: the chunk's
anchors first, then the shard's candidates block by block, so that a task holds one chunk, one block, and the best rows so far.
Nothing depends on how many rows a label or a vector has, and nothing is broadcast.

A block's candidates get one more coordinate that makes them all equally long, so that inner products are a matter of distances.
They are parted by label (labels of few rows together), and each part becomes a cover tree: a node's rows are dealt to the nearest of
up to FANOUT centres, each the row farthest from those before it, until the covering radius is half the node's. The radius that
all of a node's children share is its level's; each child also keeps that of its own rows. Nodes with few rows, and those whose
rows are so evenly spread that centres don't bring the radius down, are leaves.

A node's centre and radius bound the inner products of its rows from above and below. The descent takes the node with the highest
bound first, for all the chunk's anchors together, and each node only for the anchors it can still give something to: not if the
anchor's label rules all its rows out, not if its bounds lie outside the windows, and not if the best rows found are all above it.
Leaves are verified by exact integer products.

First each anchor's positives are found so (same label), then the negatives in the windows that the positives' scores give.

Defined cases: rows with a null label, a null or empty vector, a null or non-finite component, a vector of another length than most
rows have, or one so long that scores don't fit in 62 bits take no part; a null id is no anchor and the last of a tie; rows of equal ids are rows
each, as anchors too; a positive of negative score has no negatives, since its window is empty; an anchor without positives has no
rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import read_table, saved
from riskloom.llm.vectors import matrix, whole_vectors

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 3, 9  # window in tenths of the positive's score
CHUNK, BLOCK, SHARDS = 4096, 8192, (16, 64)
LEAF, FANOUT, SHRINK = 128, 8, 0.9
LONGEST = float(1 << 61)  # squared length
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
HITS = "row long, part int, id long, score long"


@dataclass
class Node:
    centre: np.ndarray
    radius: float  # of its own rows
    label: int | None  # None: several
    rows: np.ndarray | None = None
    children: list[Node] | None = None


class Block:
    """Candidates (ascending ids, null last) with their tree."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, no_id: np.ndarray, numbers: np.ndarray):
        order = np.lexsort((ids, no_id))
        self.x, self.labels, self.ids, self.no_id, self.numbers = x[order], labels[order], ids[order], no_id[order], numbers[order]
        plain = self.x.astype(np.float64)
        squares = (plain * plain).sum(1)
        self.square = float(squares.max())
        self.length = self.square**0.5
        self.augmented = np.concatenate([plain, np.sqrt(self.square - squares)[:, None]], 1)
        self.slack = 1e-6 * self.length + 1e-9
        self.roots = []
        few = []
        for label in np.unique(self.labels):
            rows = np.flatnonzero(self.labels == label)
            few.append(rows) if len(rows) < LEAF else self.roots.append(self.tree(rows, int(label)))
        if few:
            rows = np.sort(np.concatenate(few))
            self.roots.append(self.tree(rows, int(self.labels[rows[0]]) if len(few) == 1 else None))

    def distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (self.square - self.augmented[rows] @ self.augmented[centre]), 0))

    def tree(self, rows: np.ndarray, label: int | None) -> Node:
        root = self.node(rows, int(rows[0]), self.distances(rows, int(rows[0])), label)
        open_ = [(root, int(rows[0]), rows, self.distances(rows, int(rows[0])))]
        while open_:
            node, first, rows, near = open_.pop()
            centres, nearest, radius = [first], np.zeros(len(rows), np.int64), near.max()
            near = near.copy()
            while len(rows) > LEAF and len(centres) < FANOUT and near.max() > radius / 2:
                centre = int(rows[near.argmax()])
                apart = self.distances(rows, centre)
                closer = apart < near
                near[closer], nearest[closer] = apart[closer], len(centres)
                centres.append(centre)
            if len(centres) == 1 or near.max() > SHRINK * radius:
                node.rows = rows
                continue
            node.children = []
            for k, centre in enumerate(centres):
                own = nearest == k
                child = self.node(rows[own], centre, near[own], label)
                node.children.append(child)
                open_.append((child, centre, rows[own], near[own]))
        return root

    def node(self, rows: np.ndarray, centre: int, near: np.ndarray, label: int | None) -> Node:
        return Node(self.x[centre], float(near.max()) + self.slack, label)


class Search:
    """A chunk's anchors and the best rows found for each of their windows [low, high], whose number is the same for all."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, numbers: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.x, self.labels, self.numbers, self.low, self.high, self.k, self.same = x, labels, numbers, low, high, k, same
        plain = x.astype(np.float64)
        self.square = (plain * plain).sum(1)
        self.length = np.sqrt(self.square)
        self.kth = np.full(low.shape, LEAST)  # score of the k-th best so far
        self.best = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))  # anchor, window, score, id, whether it has none

    def add(self, block: Block) -> None:
        exact = self.length.max(initial=0) * block.length < 2.0**52
        queries = self.x.astype(np.float64) if exact else self.x
        points = block.x.astype(np.float64) if exact else block.x
        heap: list[tuple[float, int, Node, np.ndarray]] = []
        ticket = 0

        def push(node: Node, active: np.ndarray) -> None:
            nonlocal ticket
            if node.label is not None:
                active = active[(self.labels[active] == node.label) == self.same]
            if not len(active):
                return
            inner = (queries[active] @ node.centre.astype(queries.dtype)).astype(np.float64)
            length, square = self.length[active], self.square[active]
            apart = np.sqrt(np.maximum(square + block.square - 2 * inner, 0))
            slack = block.slack * length + 1e-9 * (square + block.square) + 1
            upper = np.minimum(inner + length * node.radius, (square + block.square - np.maximum(apart - node.radius, 0) ** 2) / 2) + slack
            lower = np.maximum(inner - length * node.radius, (square + block.square - (apart + node.radius) ** 2) / 2) - slack
            wanted = self.wanted(active, upper, lower)
            if wanted.any():
                ticket += 1
                heapq.heappush(heap, (-float(upper[wanted].max()), ticket, node, active[wanted], upper[wanted], lower[wanted]))

        for root in block.roots:
            push(root, np.arange(len(self.x)))
        while heap:
            _, _, node, active, upper, lower = heapq.heappop(heap)
            still = self.wanted(active, upper, lower)
            if not still.any():
                continue
            active = active[still]
            if node.children:
                for child in node.children:
                    push(child, active)
            else:
                self.verify(block, node, active, (queries[active] @ points[node.rows].T).astype(np.int64))

    def wanted(self, active: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        floor = np.maximum(self.low[active], self.kth[active])
        return ((upper[:, None] >= floor) & (lower[:, None] <= self.high[active])).any(1)

    def verify(self, block: Block, node: Node, active: np.ndarray, scores: np.ndarray) -> None:
        rows, k, hits = node.rows, self.k, []
        allowed = block.numbers[rows][None, :] != self.numbers[active][:, None]
        if node.label is None:
            allowed &= (block.labels[rows][None, :] == self.labels[active][:, None]) == self.same
        for w in range(self.low.shape[1]):
            floor, high = np.maximum(self.low[active, w], self.kth[active, w]), self.high[active, w]
            inside = allowed & (scores >= floor[:, None]) & (scores <= high[:, None])
            some = np.flatnonzero(inside.any(1))
            if not len(some):
                continue
            inside, found = inside[some], scores[some]
            if len(rows) > k:  # no row below the leaf's own k-th can be among the best
                inside &= found >= np.partition(np.where(inside, found, LEAST), len(rows) - k, axis=1)[:, len(rows) - k, None]
                # ids ascend along a leaf's rows, so of those that tie for the last places the first k are enough
                tied = inside & (found == np.where(inside, found, MOST).min(1)[:, None])
                inside &= ~tied | (np.cumsum(tied, 1) <= k)
            a, r = np.nonzero(inside)
            hits.append((active[some[a]], np.full(len(a), w), found[a, r], block.ids[rows[r]], block.no_id[rows[r]]))
        if hits:
            self.keep(hits)

    def keep(self, hits: list[tuple]) -> None:
        anchor, window, score, ids, no_id = (np.concatenate(c) for c in zip(self.best, *hits, strict=True))
        order = np.lexsort((ids, no_id, -score, window, anchor))
        group = (anchor * self.low.shape[1] + window)[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
        last = rank == self.k - 1
        self.kth.ravel()[group[last]] = score[order[last]]
        self.best = tuple(c[order[rank < self.k]] for c in (anchor, window, score, ids, no_id))

    def result(self) -> pa.RecordBatch:
        anchor, window, score, ids, no_id = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.numbers[anchor]), pa.array(window.astype(np.int32)), pa.array(ids, mask=no_id), pa.array(score)], ["row", "part", "id", "score"])


def windows_of(scores: list[list[int] | None], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each anchor's windows: one of all scores for positives; for negatives those of the positives' scores, empty ones (low above high) included."""
    if same:
        return np.full((len(scores), 1), LEAST), np.full((len(scores), 1), MOST)
    width = max(map(len, scores), default=0)
    low, high = np.full((len(scores), width), MOST), np.full((len(scores), width), LEAST)
    for k, row in enumerate(scores):
        for w, s in enumerate(row):
            if s >= 0:
                low[k, w], high[k, w] = -(-LOW * s // 10), HIGH * s // 10
    return low, high


def _search(k: int, same: bool, block_rows: int):
    """Streams sorted by chunk, shard and kind (0: anchor, 1: candidate); columns chunk, shard, kind, row, id, label, x, scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held, anchors, search = None, [], 0, [], None

        def add() -> None:
            nonlocal held, n_held, anchors, search
            if anchors:
                table = pa.Table.from_batches(anchors).combine_chunks()
                low, high = windows_of(table["scores"].to_pylist(), same)
                search = Search(matrix(table["x"].combine_chunks()), table["label"].to_numpy(), table["row"].to_numpy(), low, high, k, same)
                anchors = []
            if held and search:
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table["id"].combine_chunks()
                search.add(Block(matrix(table["x"].combine_chunks()), table["label"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), table["row"].to_numpy()))
            held, n_held = [], 0

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                here, kind = tuple(keys[start, :2].tolist()), keys[start, 2]
                if here != key:
                    add()
                    if search and len(search.best[0]):
                        yield search.result()
                    key, search = here, None
                while start < stop:
                    part = batch.slice(start, min(stop - start, block_rows - n_held))
                    start += part.num_rows
                    if kind == 0:
                        anchors.append(part)
                    else:
                        held.append(part)
                        n_held += part.num_rows
                        if n_held >= block_rows:
                            add()
        add()
        if search and len(search.best[0]):
            yield search.result()

    return run


def best_rows(anchors: DataFrame, candidates: DataFrame, k: int, same: bool, chunk: int = CHUNK, block: int = BLOCK, shards: tuple[int, int] = SHARDS) -> DataFrame:
    """(row, part, id, score, rank): the first k candidates (row, id, label, x) in each window of each anchor (also with scores, the
    positives' scores) among those of its label, or of other labels. part counts the windows."""
    n_chunks = max(1, -(-anchors.count() // chunk))
    n_shards = int(min(max(candidates.count() // 4096, shards[0]), shards[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    columns = ["row", "id", "label", "x", "scores"]
    none = F.array().cast("array<long>")
    left = anchors.select(dealt(n_chunks).alias("chunk"), every(n_shards).alias("shard"), F.lit(0).alias("kind"), *columns)
    right = candidates.select(every(n_chunks).alias("chunk"), dealt(n_shards).alias("shard"), F.lit(1).alias("kind"), *columns[:4], none.alias("scores"))
    grid = left.unionByName(right).select("chunk", "shard", "kind", *columns).repartition(n_chunks * n_shards, "chunk", "shard")
    hits = grid.sortWithinPartitions("chunk", "shard", "kind", "row").mapInArrow(_search(k, same, block), HITS)
    order = Window.partitionBy("row", "part").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, **layout: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor and label are columns of rows."""
    label = F.col("label") if label is None else label
    given = rows.where(label.isNotNull())
    table = whole_vectors(given, vector_col, LONGEST, True, id=F.col(id_col).cast("long"), label=label.cast("long"), anchor=F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)))
    table = saved(table.withColumn("row", F.monotonically_increasing_id()), "numbered")
    anchors = table.where("anchor").select("row", "id", "label", "x", F.array().cast("array<long>").alias("scores"))
    best = saved(best_rows(anchors, table, positives, True, **layout).select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("part")), "positives")
    scores = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "positive_score"))).alias("s")).select("row", F.transform("s", lambda p: p["positive_score"]).alias("scores"))
    found = best_rows(anchors.drop("scores").join(scores, "row"), table, negatives, False, **layout)
    named = best.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").withColumn("part", F.col("part") - 1)
    return found.join(named, ["row", "part"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


OP12_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
