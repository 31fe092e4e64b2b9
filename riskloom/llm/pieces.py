"""SentencePiece encoding and decoding as relations.

A text is escaped (a space in front, spaces as the mark U+2581) and cut into units, wherever no piece holds the two characters
side by side. No piece crosses a unit, so a unit's ids are the same wherever it stands, and only distinct units are encoded:

* lattice: every substring of a unit that is no longer than the longest piece is exploded and equi-joined to the piece table (its size is
  the vocabulary's, so it is broadcast); the matches are the unit's edges (begin, end, score, ids), and a character that is no
  piece has an edge of its bytes' ids;
* the edges of a unit are grouped (it is already alone in its partition) and folded by Spark's aggregate. For a unigram model
  the fold is Viterbi's: the best sum of scores up to each end. For a BPE model scores are merge ranks, whose best sum is not
  what the model's own encoder returns; there the fold takes, step by step, the edge of best score that joins two neighbours.
  Boundaries are bits of a long, so units over WIDEST characters, which prose has few of, are folded by the same rule in Python.

Units of at most FREQUENT, chosen by their counts in a sample of about SAMPLE_ROWS rows, travel to each task with their ids (a
bound on what is sent; which they are changes no result). All others are asked for once by every block of rows, encoded once, and
joined back to the blocks. Decoding takes a piece's bytes by its id (the piece table is the model's).

Defined cases: null and empty texts have no ids and decode to ""; repeated rows get a row each; a null doc_id stays null; an empty
table gives an empty result; extra columns are not read. Texts and units of any length are encoded whole. A text that holds the
mark itself decodes with a space there (round_trip is false).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import byte_slices, read_table, saved
from riskloom.llm.wordbpe import vocabulary_path

MARK = "▁"
WIDEST, FREQUENT, SAMPLE_ROWS = 48, 400_000, 40_000
NO_PIECE = 1e12  # the cost of a character that is no piece
BLOCK_BYTES, HELD_UNITS = 4 << 20, 600_000  # bytes of text cut at once; units counted before they are sent on
UNITS_A_PART, PARTS_A_SPLIT, FALLBACK, FALLBACK_SETTING = 10_000, 8, "30000", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
UNIGRAM, BPE = 1, 2
FIRST_BYTE_ID = 3
# an edge of a narrow unit as one long: the score's place, begin (6 bits), end (6 bits), id (20 bits; all set: the bytes' ids)
PLACE_BIT, BEGIN_BIT, END_BIT, NO_ID = 32, 26, 20, (1 << 20) - 1


def load_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def piece_table(spark: SparkSession, model) -> DataFrame:
    """(piece, id, score, code) of the ordinary pieces; code is the place of the score, best first, above the id's bits."""
    rows = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
    if len(model.pieces) > NO_ID:
        raise ValueError(f"the model may have at most {NO_ID} pieces")
    place = {score: i for i, score in enumerate(sorted({r[2] for r in rows}, reverse=True))}
    codes = [place[score] << PLACE_BIT | i for _, i, score in rows]
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": [float(r[2]) for r in rows], "code": pa.array(codes, pa.int64())}))


def bpe_by_heap(unit: str, rank: dict[str, float]) -> list[int]:
    """Boundaries left after joining neighbours whose whole is a piece: the least rank first, then the leftmost."""
    n = len(unit)
    ahead, back, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * (n + 1)
    heap = [(rank[unit[i : i + 2]], i, i + 2, i + 1) for i in range(n - 1) if unit[i : i + 2] in rank]
    heapq.heapify(heap)
    while heap:
        _, b, e, m = heapq.heappop(heap)
        if not (alive[b] and alive[e] and alive[m] and ahead[b] == m and ahead[m] == e):
            continue
        alive[m] = False
        ahead[b], back[e] = e, b
        if e < n and unit[b : ahead[e]] in rank:
            heapq.heappush(heap, (rank[unit[b : ahead[e]]], b, ahead[e], e))
        if b > 0 and unit[back[b] : e] in rank:
            heapq.heappush(heap, (rank[unit[back[b] : e]], back[b], e, b))
    return [i for i in range(n + 1) if alive[i]]


def viterbi_by_steps(unit: str, rank: dict[str, float]) -> list[int]:
    """Boundaries of the path of least cost; a character that is no piece costs more than any path of pieces."""
    n, longest = len(unit), max(map(len, rank), default=1)
    best, came = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for b in range(max(0, e - longest), e):
            cost = rank.get(unit[b:e], NO_PIECE if e - b == 1 else float("inf"))
            if best[b] + cost < best[e]:
                best[e], came[e] = best[b] + cost, b
    at, found = n, [n]
    while at:
        at = came[at]
        found.append(at)
    return found[::-1]


def _fold_wide(bpe: bool, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {p.piece: (i, -p.score) for i, p in enumerate(load_model(path).pieces) if p.type in (1, 4)}
        rank, fold = {p: r for p, (_, r) in pieces.items()}, bpe_by_heap if bpe else viterbi_by_steps
        for batch in batches:
            found = []
            for unit in batch.column("unit").to_pylist():
                cuts = fold(unit, rank)
                parts = [unit[b:e] for b, e in zip(cuts, cuts[1:], strict=False)]
                found.append([i for p in parts for i in ([pieces[p][0]] if p in pieces else [x + FIRST_BYTE_ID for x in p.encode()])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return run


def matches(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The columns of units with (b, e, piece, id, score, code) of every substring that is a piece and of every character.
    Begins and lengths are exploded one after the other, which stays in generated code."""
    begins = units.select("*", F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("b"))
    lengths = begins.select("*", F.explode(F.expr(f"sequence(1, least({longest}, length(unit) - b))")).alias("l"))
    spans = lengths.select(*units.columns, "b", F.expr("b + l").alias("e"), F.expr("substring(unit, b + 1, l)").alias("piece"))
    return spans.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR e - b = 1")


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The columns of distinct units, and their edges by rank and begin."""
    of_bytes = f"transform(sequence(1, length(hex(encode(piece, 'UTF-8'))), 2), i -> cast(conv(substring(hex(encode(piece, 'UTF-8')), i, 2), 16, 10) AS int) + {FIRST_BYTE_ID})"
    edge = F.expr(f"struct(coalesce(-score, {NO_PIECE!r}D) AS rank, b, e, CASE WHEN id IS NOT NULL THEN array(id) ELSE {of_bytes} END AS ids)")
    return matches(units, pieces, longest).groupBy(*units.columns).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def ranked_lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """As lattice, for narrow units of a BPE model: each edge is one long, so that they sort by rank and begin as numbers."""
    edge = F.expr(f"coalesce(code, {1 << 52 | NO_ID}L) | shiftleft(cast(b AS long), {BEGIN_BIT}) | shiftleft(cast(e AS long), {END_BIT})")
    return matches(units, pieces, longest).groupBy(*units.columns).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


# Boundaries as bits: of an edge, its ends and all from its begin to its end. What a lambda reads often is carried in the state,
# so that it is computed once a unit; edges that can no longer join leave the state.
_ENDS = "(shiftleft(1L, x.b) | shiftleft(1L, x.e))"
_SPAN = "(shiftleft(shiftleft(1L, x.e - x.b + 1) - 1L, x.b))"
_IDS = f"flatten(transform(array_sort(filter(edges, x -> s.bounds & {_ENDS} = {_ENDS} AND bit_count(s.bounds & {_SPAN}) = 2), (x, y) -> x.b - y.b), x -> x.ids))"
_B, _E = (f"cast(shiftright(x, {bit}) & 63L AS int)" for bit in (BEGIN_BIT, END_BIT))
_LONG_ENDS, _LONG_SPAN = f"(shiftleft(1L, {_B}) | shiftleft(1L, {_E}))", f"(shiftleft(1L, {_E} + 1) - shiftleft(1L, {_B}))"
_NEXT = "get(filter(s.joins, x -> bit_count(s.bounds & x.span) = 3), 0)"
_MERGE = f"""aggregate(sequence(1, length(unit)), struct(shiftleft(1L, length(unit) + 1) - 1L AS bounds, transform(filter(edges, x -> {_E} - {_B} > 1), x -> struct({_LONG_ENDS} AS ends, {_LONG_SPAN} AS span)) AS joins),
    (s, i) -> CASE WHEN size(s.joins) = 0 THEN s ELSE aggregate(transform(array({_NEXT}), x -> s.bounds & (~x.span | x.ends)), s,
        (s, after) -> CASE WHEN after IS NULL THEN struct(s.bounds AS bounds, filter(s.joins, x -> false) AS joins)
            ELSE struct(after AS bounds, filter(s.joins, x -> after & x.ends = x.ends AND bit_count(after & x.span) > 2) AS joins) END) END,
    s -> s.bounds)"""
_CHARACTER = f"hex(encode(substring(unit, {_B} + 1, 1), 'UTF-8'))"
_MERGED_IDS = f"""flatten(transform(sort_array(transform(filter(edges, x -> bounds & {_LONG_ENDS} = {_LONG_ENDS} AND bit_count(bounds & {_LONG_SPAN}) = 2), x -> x & {(1 << PLACE_BIT) - 1}L)),
    x -> CASE WHEN x & {NO_ID}L = {NO_ID}L THEN transform(sequence(1, length({_CHARACTER}), 2), i -> cast(conv(substring({_CHARACTER}, i, 2), 16, 10) AS int) + {FIRST_BYTE_ID}) ELSE array(cast(x & {NO_ID}L AS int)) END))"""
_VITERBI = f"""aggregate(array_sort(edges, (x, y) -> CASE WHEN x.e <> y.e THEN x.e - y.e ELSE x.b - y.b END),
    transform(sequence(0, n), i -> struct(CASE WHEN i = 0 THEN 0D ELSE double('infinity') END AS cost, CASE WHEN i = 0 THEN 1L ELSE 0L END AS bounds)),
    (best, x) -> CASE WHEN best[x.b].cost + x.rank < best[x.e].cost
        THEN transform(best, (s, i) -> CASE WHEN i = x.e THEN struct(best[x.b].cost + x.rank AS cost, best[x.b].bounds | shiftleft(1L, x.e) AS bounds) ELSE s END) ELSE best END,
    best -> transform(slice(best, n + 1, 1), s -> {_IDS})[0])"""


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """The columns of units, whose column unit holds distinct non-empty units, and ids."""
    spark, model = units.sparkSession, load_model(path)
    bpe = model.trainer_spec.model_type == BPE
    if not bpe and model.trainer_spec.model_type != UNIGRAM:
        raise ValueError("the model has to be unigram or BPE")
    table, width, longest = piece_table(spark, model), F.length("unit"), max(len(p.piece) for p in model.pieces if p.type in (1, 4))
    narrow = units.where(width <= WIDEST)
    if bpe:
        narrow = ranked_lattice(narrow, table, longest).withColumn("bounds", F.expr(_MERGE)).select(*units.columns, F.expr(_MERGED_IDS).alias("ids"))
    else:
        narrow = lattice(narrow, table, longest).withColumn("n", width).select(*units.columns, F.expr(_VITERBI).alias("ids"))
    wide = units.where(width > WIDEST).mapInArrow(_fold_wide(bpe, path), T.StructType([*units.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return narrow.unionByName(wide)


class Cutter:
    """Cuts texts into units with numpy and Arrow. Two characters stay together only where some piece holds them side by side, since no
    merge reaches over others; so a unit is at most a word with its mark, and a word's signs are mostly units of their own."""

    def __init__(self, pieces: list[str]):
        together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.number = np.zeros(0x110000, np.int32)
        known = sorted({ord(c) for pair in together for c in pair})
        self.number[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[self.number[ord(a)] * self.width + self.number[ord(b)] for a, b in together]] = True

    def units(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct units, the number of each unit of all texts, each text's count of units)."""
        escaped = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        sizes = np.array([len(e) for e in escaped], np.int64)
        whole = "".join(escaped)
        if not whole:
            return pa.array([], pa.string()), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[code]
        begins = np.empty(len(code), bool)
        begins[0] = True
        np.logical_not(self.joined[number[:-1] * self.width + number[1:]], out=begins[1:])
        starts = np.cumsum(sizes) - sizes
        begins[starts[sizes > 0]] = True
        first = np.flatnonzero(begins)
        ends = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))
        offsets = np.append(np.where(first > 0, ends[first - 1], 0), ends[-1]).astype(np.int32)
        offsets[0] = 0
        data = whole.encode("utf-8", "surrogatepass")
        coded = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        counts = np.searchsorted(first, np.append(starts, len(code)))
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(counts)


def _unit_counts(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in byte_slices(batches, 0, BLOCK_BYTES):
            units, numbers, _ = cutter.units(part.column(0).to_pylist())
            held.append(pa.table({"unit": units, "c": np.bincount(numbers, minlength=len(units)).astype(np.int64)}))
            size += len(units)
            if size > HELD_UNITS:
                yield from _summed(held)
                held, size = [], 0
        yield from _summed(held)

    return run


def _summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
    if not held:
        return []
    sums = pa.concat_tables(held).group_by("unit").aggregate([("c", "sum")])
    return sums.rename_columns({"c_sum": "c"}).select(["unit", "c"]).to_batches(max_chunksize=100_000)


def cutter_of(path: str) -> Cutter:
    return Cutter([p.piece for p in load_model(path).pieces if p.type in (1, 4)])


class Frequent:
    """The ids of the units that are looked up where they stand; a bound on what is sent to each task."""

    def __init__(self, rows: pa.Table):
        self.units = rows["unit"].combine_chunks()
        ids = rows["ids"].combine_chunks()
        self.ids, self.begins = ids.flatten().to_numpy().astype(np.int32), np.asarray(ids.offsets).astype(np.int64) - ids.offsets[0].as_py()

    def place(self, units: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(units, self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def frequent_units(docs: DataFrame, path: str, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Frequent:
    """The FREQUENT most frequent units of about sample_rows rows, with their ids. Which they are changes no result."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    counted = docs.select(F.col(text_col).cast("string")).sample(share, seed=7).mapInArrow(_unit_counts(cutter_of(path)), "unit string, c long").groupBy("unit").agg(F.sum("c").alias("c"))
    top = saved(counted.orderBy(F.desc("c"), "unit").limit(FREQUENT).select("unit"), "frequent-units")
    return Frequent(encode_in_parts(top, FREQUENT // UNITS_A_PART, path).toArrow())


def encode_in_parts(units: DataFrame, parts: int, path: str) -> DataFrame:
    """encode_units of distinct units. They are dealt out so that few lie in a partition, whose edges are then grouped in memory, by
    hash; beyond FALLBACK units Spark sorts them instead."""
    spark = units.sparkSession
    before = spark.conf.get(FALLBACK_SETTING)
    spark.conf.set(FALLBACK_SETTING, FALLBACK)
    try:
        return saved(encode_units(units.repartition(parts, "unit").distinct(), path), "vocabulary", compression="zstd")
    finally:
        spark.conf.set(FALLBACK_SETTING, before)


def _blocks(cutter: Cutter, frequent, pieces: int, requests: bool):
    """Of each block of rows, numbered by partition and place: either the rare units that it needs, or its ids, packed, with pieces + k for its k-th rare unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Frequent = frequent.value
        block, codec = TaskContext.get().partitionId() << 40, pa.Codec("zstd", 9)
        for part in byte_slices(batches, 1, BLOCK_BYTES):
            texts = part.column(1).to_pylist()
            units, numbers, counts = cutter.units(texts)
            place = known.place(units)
            rare = np.flatnonzero(place < 0)
            if requests:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), block)), pa.array(np.arange(len(rare), dtype=np.int32)), units.take(pa.array(rare))], ["block", "k", "unit"])
            else:
                begin, length = np.zeros(len(units), np.int64), np.ones(len(units), np.int64)
                often = place >= 0
                begin[often], length[often] = known.begins[place[often]], np.diff(known.begins)[place[often]]
                begin[rare] = len(known.ids) + np.arange(len(rare))
                pool = np.append(known.ids, pieces + np.arange(len(rare), dtype=np.int32))
                flat, at = _strung(pool, begin[numbers], length[numbers])
                sizes = np.diff(at[np.concatenate([[0], np.cumsum(counts)])])
                top, others, data = packed_ids(flat)
                crc = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                row = {"block": block, "doc_ids": part.column(0).to_pylist(), "sizes": sizes, "crc": crc, "top": top, "others": others, "packed": codec.compress(data, asbytes=True)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("crc", pa.list_(pa.int64())), ("top", pa.list_(pa.int32())), ("others", pa.int64()), ("packed", pa.binary())]))
            block += 1

    return run


def _strung(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[begin:begin + length] one after the other, and where each begins and the last ends."""
    at = np.concatenate([[0], np.cumsum(length)])
    return pool[np.repeat(begin - at[:-1], length) + np.arange(at[-1])], at


def packed_ids(ids: np.ndarray) -> tuple[np.ndarray, int, bytes]:
    """(top, others, data): a byte for each id, its place among the 255 most frequent, top, or 255; then the others' bytes, all the
    lowest first. So most ids take a byte, and what always is zero packs to nothing."""
    top = np.argsort(-np.bincount(ids), kind="stable")[:255].astype(np.int32)
    place = np.full(int(ids.max(initial=0)) + 1, 255, np.uint8)
    place[top] = np.arange(len(top))
    first = place[ids]
    rest = ids[first == 255].astype("<u4")
    return top, len(rest), first.tobytes() + rest.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_ids(top: np.ndarray, others: int, data: bytes) -> np.ndarray:
    """The ids that packed_ids was given."""
    first = np.frombuffer(data, np.uint8, len(data) - 4 * others)
    ids = np.append(top, np.zeros(256 - len(top), np.int64)).astype(np.int64)[first]
    ids[first == 255] = np.frombuffer(data, np.uint8, 4 * others, len(first)).reshape(4, -1).T.copy().view("<u4").ravel()
    return ids


def decoder_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begins): the bytes of piece i, its marks as spaces, are bytes[begins[i]:begins[i + 1]]; control pieces have none."""
    table = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else b"" for p in load_model(path).pieces]
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)


def decode_flat(ids: np.ndarray, cuts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The bytes of texts whose ids are ids[cuts[k]:cuts[k + 1]], without the space in front."""
    data, begins = table
    found, at = _strung(data, begins[:-1][ids], np.diff(begins)[ids])
    flat, ends = found.tobytes(), at[cuts].tolist()
    return [flat[a + (flat[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _filled(path: str):
    """Blocks of packed ids, with their rare units' ids by k, to rows of ids, each decoded again and held against its text's crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codec = decoder_of(path), pa.Codec("zstd")
        pieces = len(table[1]) - 1
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                doc_ids, sizes, crc = (row.column(k).flatten() for k in range(3))
                sizes, top, others = sizes.to_numpy(), row.column(3).flatten().to_numpy(), row.column(4)[0].as_py()
                coded = unpacked_ids(top, others, codec.decompress(row.column(5)[0].as_py(), int(sizes.sum()) + 4 * others, asbytes=True))
                rare = row.column(6).flatten()
                pool = np.concatenate([np.arange(pieces, dtype=np.int32), rare.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
                offsets = np.asarray(rare.offsets).astype(np.int64) if len(rare) else np.zeros(1, np.int64)
                begins = np.concatenate([np.arange(pieces), pieces + offsets[:-1] - offsets[0]])
                lengths = np.concatenate([np.ones(pieces, np.int64), np.diff(offsets)])
                ids, at = _strung(pool, begins[coded], lengths[coded])
                cuts = at[np.concatenate([[0], np.cumsum(sizes)])]
                same = [zlib.crc32(t) == c for t, c in zip(decode_flat(ids, cuts, table), crc.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every row. docs is scanned twice and has to give the same rows in the same partitions
    each time, as a table does. round_trip: whether the ids decode to the text."""
    spark, path = docs.sparkSession, path or vocabulary_path("piece_bpe_32k.model")
    frequent, cutter, pieces = spark.sparkContext.broadcast(frequent_units(docs, path, text_col)), cutter_of(path), len(load_model(path).pieces)
    given = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    asked = saved(given.mapInArrow(_blocks(cutter, frequent, pieces, True), "block long, k int, unit string"), "rare-units", compression="zstd")
    vocabulary = encode_in_parts(asked.select("unit"), max(1, docs.rdd.getNumPartitions()) * PARTS_A_SPLIT, path)
    rare = asked.join(vocabulary, "unit").groupBy("block").agg(F.array_sort(F.collect_list(F.concat(F.array("k"), "ids"))).alias("rare")).select("block", F.expr("transform(rare, x -> slice(x, 2, size(x) - 1))").alias("rare"))
    blocks = given.mapInArrow(_blocks(cutter, frequent, pieces, False), "block long, doc_ids array<long>, sizes array<long>, crc array<long>, top array<int>, others long, packed binary")
    whole = blocks.join(rare, "block", "left").select("doc_ids", "sizes", "crc", "top", "others", "packed", F.coalesce("rare", F.expr("cast(array() AS array<array<int>>)")))
    return whole.mapInArrow(_filled(path), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder_of(path)
        for batch in batches:
            lists = batch.column(1)
            cuts = np.asarray(lists.offsets).astype(np.int64)
            texts = decode_flat(lists.values.to_numpy(zero_copy_only=False), cuts, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["key", "text"])

    return run


def decode_ids(rows: DataFrame, path: str, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, text) of each row's ids: marks are spaces, and the space in front is taken off. Rows without ids have the text ""."""
    found = rows.select(key, F.coalesce(F.col(ids_col).cast("array<int>"), F.expr("cast(array() AS array<int>)"))).mapInArrow(_decode(path), T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("text", T.StringType())]))
    return found.withColumnRenamed("key", key)


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
