"""Language-model scores by online logistic context mixing over hashed-context bit predictors.

A text is its tokens: words, lower-cased in A-Z, and one end. It is coded by binary decisions, each foretold by several contexts:

* repeated: texts are cut into chunks, after every token whose hash with the token before it says so (one in CHUNK on average).
  The hash of a chunk foretells the chunk after it, by the counts of all training texts. The first decision of a chunk that is
  foretold is whether it comes; if so, its tokens cost nothing more.
* seen: whether a token has stood in this text before. If so, it is chosen by its count here.
* known: whether a token that is new here stands in the training texts. If so, it is chosen by its count in the texts of this
  text's class and in all texts (a class is a hash of a text's most frequent short word, which goes with its language).
* spelled: other tokens are coded byte by byte and bit by bit. Four contexts (the last one to three bytes and all of the word so
  far), each joined with the known bits of the byte and hashed into a table, count how often the next bit was 0 or 1 in the words
  of the training texts; their log odds are mixed by weights that the known bits select. These weights are learned online on all
  words, in blocks of about LEARN_BLOCK, and averaged over them. A word of any length costs what its bits cost.

The decisions seen and known have four predictors each, which count in this text, under a context, how often the decision was yes:
no context, the last two decisions, the token before, and how far the text has come; repeated has the counts of the chunk before
it in the training texts, and the text's own. Log odds are mixed by weights that a gate selects (the decision, and how often its
context was met), updated by the error after every STEP tokens of the text, and refined by the text's own record of how often
decisions of such odds came true.

Counts that a training text is scored by are those of the other texts, so texts that occur twice are told apart from those that
occur once. Every token's count is joined to its text, however rare it is; the FREQUENT ones travel to each task instead (a bound
on what is sent, which changes no result).

Defined cases: null and empty texts are the end alone; a null doc_id counts as the text "" for the fold; repeated rows get a row
each; without training rows N and V are 0 and the model falls back to even odds; an empty table gives an empty result; extra
columns are not read. Texts of any length are scored whole. Texts are read several times and have to come in the same rows and
partitions each time, as those of a table do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import byte_slices, id_text, read_table, saved

FOLDS, HELD_OUT = 5, 1
ORDER_BITS = (11, 16, 20, 20)  # slots of the contexts of 1 to 3 bytes and of the whole prefix, as powers of two
FREQUENT, CLASSED, LEARN_BLOCK = 600_000, 50_000, 40_000
BLOCK_BYTES, SLOTS, FAN_IN = 4 << 20, 1 << 15, 32
BLOCK, COUNT_BLOCK = 1 << 15, 1 << 16  # bytes of words handled at once
TERMINATOR = 0x20
RATE, START = 0.3, 0.4
CLASSES, SHORT = 16, 4
CHUNK = 16
SEEN, KNOWN, REPEATED = 0, 1, 2
PREDICTORS, GATES, STEP = 4, 12, 32
FIRST_WEIGHT, PACE, PULL, OWN_SHARE, REFINERS = 0.35, 0.02, 8.0, 0.75, 24
STARTS = np.cumsum([0, *(1 << b for b in ORDER_BITS)])
HASH_A, HASH_B, HASH_R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x100000001B3)

BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, kinds array<int>, bytes array<long>, packed binary, chunks array<int>, contexts array<int>, hashes array<int>"


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(id_text(id_col)) % FOLDS == HELD_OUT


def tokenized(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Tokens of all texts, the empty word at the end of each, and the number of each text's tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = split.flatten(), np.asarray(split.offsets) - np.asarray(split.offsets)[0]
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    empty = words.index("") if "" in words else len(words)  # of white space at a text's ends
    dictionary = coded.dictionary if empty < len(words) else pa.array([*words, ""], pa.string())
    indices = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = indices != empty
    lengths = np.bincount(text_of[full], minlength=len(texts))
    indices = np.insert(indices[full], np.cumsum(lengths), empty).astype(np.int32)
    return pa.DictionaryArray.from_arrays(pa.array(indices), dictionary), lengths + 1


def text_classes(words: np.ndarray, lengths: np.ndarray, dictionary: pa.Array) -> np.ndarray:
    """Of each text the hash of its most frequent word of 1 to SHORT bytes; of several the one with the largest hash."""
    size = np.asarray(pc.binary_length(dictionary))
    short = (size > 0) & (size <= SHORT)
    crc = np.zeros(len(dictionary), np.int64)
    at = np.flatnonzero(short)
    crc[at] = [zlib.crc32(w.encode()) for w in dictionary.take(pa.array(at)).to_pylist()]
    text = np.repeat(np.arange(len(lengths)), lengths)
    chosen = short[words]
    key, counts = np.unique(text[chosen] * len(dictionary) + words[chosen], return_counts=True)
    order = np.lexsort((crc[key % len(dictionary)], counts, key // len(dictionary)))
    found = np.full(len(lengths), zlib.crc32(b"") % CLASSES)
    found[(key // len(dictionary))[order]] = (crc[key % len(dictionary)] % CLASSES)[order]  # the last of a text stays
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, 0, BLOCK_BYTES):
        tokens, lengths = tokenized(part.column(0))
        words = np.asarray(tokens.indices)
        kind = np.repeat(text_classes(words, lengths, tokens.dictionary), lengths)
        counts = np.bincount(words * CLASSES + kind, minlength=len(tokens.dictionary) * CLASSES)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(some // CLASSES)), pa.array((some % CLASSES).astype(np.int32)), pa.array(counts[some])], ["word", "kind", "c"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, c, by) over the training rows: the count of each token, overall and by the text's class; the end is the empty word."""
    training = docs.where(~held_out(id_col)).select(F.col(text_col).cast("string"))
    counted = training.mapInArrow(_count, "word string, kind int, c long")
    sums = counted.groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(f"k{k}") for k in range(CLASSES)])
    return saved(sums.select("word", "c", F.array(*[F.coalesce(f"k{k}", F.lit(0)) for k in range(CLASSES)]).alias("by")), "token-counts")


def chunks_of(words: np.ndarray, lengths: np.ndarray, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, contexts, hashes) of all texts' chunks: the place of each one's first token, the hash of the chunk before it (of a
    text's first chunk, a number of its own) and 32 bits of its own hash."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in dictionary.to_pylist()], np.uint64)[words]
    pair = (of_word[1:] * HASH_A ^ of_word[:-1]) * HASH_B
    begin = np.zeros(len(words), bool)
    firsts = np.cumsum(lengths) - lengths
    begin[1:] = (pair >> np.uint64(32)) % np.uint64(CHUNK) == 0
    begin[:] = np.concatenate([[True], begin[1:]])
    begin[firsts] = True
    begins = np.flatnonzero(begin)
    size = np.diff(np.append(begins, len(words)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), HASH_R)]), dtype=np.uint64)
    whole = np.add.reduceat((of_word | np.uint64(1)) * powers[np.arange(len(words)) - np.repeat(begins, size)], begins)
    whole = (whole ^ (whole >> np.uint64(31))) * HASH_A
    before = np.concatenate([[np.uint64(0)], whole[:-1]])
    before[np.searchsorted(begins, firsts)] = HASH_B
    return begins, before.view(np.int64), (whole >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block of rows the chunks and what comes before them, with how often they come so in its training texts. The first row
    of a context has the context's number in the block and need, which is 2 where only training texts have it: there a chunk that
    all texts hold once tells nothing."""
    block = TaskContext.get().partitionId() << 40
    for part in byte_slices(batches, 2, BLOCK_BYTES):
        tokens, lengths = tokenized(part.column(2))
        begins, contexts, hashes = chunks_of(np.asarray(tokens.indices), lengths, tokens.dictionary)
        held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[np.searchsorted(np.cumsum(lengths), begins, "right")]
        order = np.lexsort((hashes, contexts))
        contexts, hashes, held = contexts[order], hashes[order], held[order]
        lead = np.concatenate([[True], contexts[1:] != contexts[:-1]])[: len(order)]
        fresh = np.flatnonzero(lead | np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(order)])
        number = np.cumsum(lead) - 1
        need = np.where(np.bincount(number, held) > 0, 1, 2)[number]
        c = np.add.reduceat(~held, fresh, dtype=np.int32) if len(fresh) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(fresh), block)), pa.array(np.where(lead, number, -1)[fresh].astype(np.int32)), pa.array(contexts[fresh]), pa.array(hashes[fresh]), pa.array(c), pa.array(need[fresh].astype(np.int32))],
            ["block", "k", "context", "chunk", "c", "need"],
        )
        block += 1


def chunk_table(chunks: DataFrame) -> DataFrame:
    """(context, total, best, best_c) of every chunk of the training rows: how often it was followed, by which chunk most often, and how often by that."""
    counted = chunks.where("c > 0").groupBy("context", "chunk").agg(F.sum("c").alias("c"))
    top = F.max(F.struct("c", "chunk"))
    return counted.groupBy("context").agg(F.sum("c").alias("total"), top.alias("top")).select("context", "total", F.col("top.chunk").alias("best"), F.col("top.c").alias("best_c"))


def coded_bits(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' bytes and terminators, one row each: slots (by context, 8 bits a row), nodes (8), bits (8); and where each word's rows begin."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    flat = np.insert(data, ends, TERMINATOR).astype(np.uint64)
    begins = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1))[:-1]]).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat))))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), HASH_R)]), dtype=np.uint64)
    terms = (flat + np.uint64(1)) * powers[place]
    before = np.cumsum(terms, dtype=np.uint64) - terms
    contexts, last = [], np.zeros(len(flat), np.uint64)
    for k in range(1, len(ORDER_BITS)):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[k:] = flat[:-k]
        last = last * np.uint64(257) + np.where(place >= k, shifted + np.uint64(1), np.uint64(0))
        contexts.append(last)
    contexts.append(before - before[np.repeat(begins, np.diff(np.append(begins, len(flat))))])
    byte = flat.astype(np.int64)[:, None]
    shift = np.arange(7, -1, -1)
    nodes, bits = (1 << np.arange(8)) | (byte >> (shift + 1)), (byte >> shift) & 1
    mixed = nodes.astype(np.uint64) * HASH_B
    slots = np.empty((len(contexts), len(flat), 8), np.int64)
    for k, (c, b) in enumerate(zip(contexts, ORDER_BITS, strict=True)):
        hashed = (c * HASH_A)[:, None] ^ mixed
        hashed *= HASH_A
        hashed >>= np.uint64(64 - b)
        np.add(hashed.view(np.int64), STARTS[k], out=slots[k])
    return slots, nodes, bits, begins


def pieces(words: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first, words) in runs of about block bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(words)) + 1)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        yield at, words.slice(at, to - at)
        at = to


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's table of bit counts, in chunks of slots (0 and 1 side by side)."""
    table = np.zeros(2 * STARTS[-1], np.int64)
    for batch in batches:
        for _, words in pieces(batch.column(0), COUNT_BLOCK):
            slots, _, bits, _ = coded_bits(words)
            for k, begin in enumerate(2 * STARTS[:-1]):  # a context at a time, so that little is held beside the table
                part = table[begin : 2 * STARTS[k + 1]]
                part += np.bincount((2 * slots[k] + bits - begin).ravel(), minlength=len(part))
    number = TaskContext.get().partitionId()
    for chunk in range(0, len(table), SLOTS):
        part = table[chunk : chunk + SLOTS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk // SLOTS]), pa.array([number]), pa.array([part], pa.list_(pa.int64()))], ["chunk", "number", "counts"])


def _add(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "number": [key[1]], "counts": [np.sum(np.stack(table["counts"].to_list()), axis=0)]})


def bit_table(counts: DataFrame) -> np.ndarray:
    """How often the bit was 0 and 1 in every slot. Partitions' tables are added up FAN_IN at a time, so no task gathers them all."""
    schema = "chunk long, number long, counts array<long>"
    tables = saved(counts.select("word").mapInArrow(_bit_counts, schema), "bit-counts")
    parts = counts.rdd.getNumPartitions()
    while parts > 1:
        tables = saved(tables.groupBy("chunk", F.floor(F.col("number") / FAN_IN).cast("long").alias("number")).applyInPandas(_add, schema), "bit-counts")
        parts = -(-parts // FAN_IN)
    table = np.zeros(2 * STARTS[-1], np.int64)
    for row in tables.toLocalIterator():  # a table of fixed size
        table[row["chunk"] * SLOTS : row["chunk"] * SLOTS + len(row["counts"])] = row["counts"]
    return table.astype(np.float32)


def _learn(table, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = np.full((256, orders), 1 / orders), 0.0
        for batch in batches:
            for _, words in pieces(batch.column(0)):
                slots, nodes, bits, _ = coded_bits(words)
                for lo in range(0, len(bits), 512):  # rows enough for a steady step
                    slot, node, bit = slots[:, lo : lo + 512].reshape(orders, -1).T, nodes[lo : lo + 512].ravel(), bits[lo : lo + 512].ravel()[:, None]
                    zero, one = table.value[2 * slot] - (bit == 0), table.value[2 * slot + 1] - (bit == 1)  # without this word itself
                    x = np.log((one + START) / (zero + START))
                    p = 1 / (1 + np.exp(-np.clip((x * weights[node]).sum(1), -30, 30)))
                    error, total = bit[:, 0] - p, np.maximum(np.bincount(node, minlength=256), 8)
                    for k in range(orders):
                        weights[:, k] += RATE * np.bincount(node, error * x[:, k], 256) / total
                seen += len(words)
        yield pa.RecordBatch.from_arrays([pa.array([weights.ravel().tolist()], pa.list_(pa.float64())), pa.array([seen])], ["weights", "seen"])

    return run


@dataclass
class Model:
    """What scoring sends to each task; its size is bounded by ORDER_BITS, FREQUENT and CLASSED."""

    table: np.ndarray
    weights: np.ndarray
    words: pa.Array  # the FREQUENT words
    counts: np.ndarray
    by: np.ndarray  # of the first CLASSED their counts by class
    keys: np.ndarray  # of the others word and class (see class_keys), in order, and the count there
    in_class: np.ndarray
    n: int
    v: int
    new_rate: float
    class_tokens: np.ndarray
    class_texts: np.ndarray

    def word_log2(self, words: pa.Array) -> np.ndarray:
        """Log2 of the bit mixer's probability of each word."""
        found = np.zeros(len(words))
        for at, part in pieces(words):
            slots, nodes, bits, begins = coded_bits(part)
            odds = sum(self.table[slots[k]] * self.weights[:, k][nodes] for k in range(len(slots)))
            cost = np.logaddexp(0, np.where(bits == 1, -odds, odds)).sum(1)
            found[at : at + len(part)] = -np.add.reduceat(cost, begins) / np.log(2)
        return found


def _by_class() -> Column:
    """Of a word its count in each class that has it, with the class as the last digit to base CLASSES."""
    return F.filter(F.transform("by", lambda c, k: c * CLASSES + k), lambda x: x >= CLASSES)


def class_keys(by: pa.Array, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of words numbered from first on, from their _by_class: number and class as one number, in order, and the count there."""
    flat, word = by.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(by).to_numpy(zero_copy_only=False)
    return (first + word) * CLASSES + flat % CLASSES, flat // CLASSES


def block_weights(counts: DataFrame, table, words: int) -> DataFrame:
    """(weights, seen): what each block of the words learns, and how many it has. Blocks are dealt by the words, in an order of their own."""
    blocks = counts.select("word").repartition(max(8, -(-words // LEARN_BLOCK)), "word").sortWithinPartitions(F.xxhash64("word"), "word")
    return blocks.mapInArrow(_learn(table, len(ORDER_BITS)), "weights array<double>, seen double")


def fit(counts: DataFrame) -> Model:
    """The model of the training texts' counts. All their words teach the first weights."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), *[F.coalesce(F.sum(F.col("by")[k]), F.lit(0)).alias(f"n{k}") for k in range(CLASSES)], *[F.coalesce(F.max(F.when(F.col("word") == "", F.col("by")[k])), F.lit(0)).alias(f"d{k}") for k in range(CLASSES)]).first()
    table = bit_table(counts)
    shared = spark.sparkContext.broadcast(table)
    learned = block_weights(counts, shared, total["v"])
    means = learned.select(F.posexplode("weights").alias("k", "w"), "seen").groupBy("k").agg((F.sum(F.col("w") * (F.col("seen") + 1e-9)) / F.sum(F.col("seen") + 1e-9)).alias("w")).toPandas()  # 256 gates x contexts
    weights = np.full(256 * len(ORDER_BITS), 1 / len(ORDER_BITS))
    weights[means["k"].to_numpy(int)] = means["w"]
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).select("word", "c", _by_class().alias("by")).toArrow()
    keys, in_class = class_keys(top["by"].combine_chunks(), 0)
    dense = min(CLASSED, len(top))
    at = np.searchsorted(keys, dense * CLASSES)
    by = np.zeros(dense * CLASSES, np.int64)
    by[keys[:at]] = in_class[:at]
    odds = np.log((table[1::2] + START) / (table[::2] + START)).astype(np.float16)
    columns = [np.array([total[f"{x}{k}"] for k in range(CLASSES)]) for x in "nd"]
    return Model(odds, weights.reshape(256, -1).astype(np.float32), top["word"].combine_chunks(), top["c"].to_numpy(), by.reshape(-1, CLASSES), keys[at:], in_class[at:], total["n"], total["v"], min(max(total["once"] / max(total["n"], 1), 0.001), 0.5), *columns)


def _ask(model):
    """The words of each block of rows that don't travel with the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for part in byte_slices(batches, 2, BLOCK_BYTES):
            tokens, _ = tokenized(part.column(2))
            rare = np.flatnonzero(_place(model.value, tokens.dictionary) < 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), block)), pa.array(np.arange(len(rare), dtype=np.int32)), tokens.dictionary.take(pa.array(rare))], ["block", "k", "word"])
            block += 1

    return run


def _place(model: Model, words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, model.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codec, m = TaskContext.get().partitionId() << 40, pa.Codec("zstd"), model.value
        for part in byte_slices(batches, 2, BLOCK_BYTES):
            tokens, lengths = tokenized(part.column(2))
            words, dictionary = np.asarray(tokens.indices), tokens.dictionary
            place = _place(m, dictionary)
            place[place < 0] = len(m.words) + np.arange((place < 0).sum())
            begins, contexts, hashes = chunks_of(words, lengths, dictionary)
            size = (np.asarray(pc.binary_length(dictionary)).astype(np.int64) + 1)[words]
            row = {
                "block": block, "doc_ids": part.column(0).to_pylist(), "held_out": part.column(1).to_pylist(), "sizes": lengths, "kinds": text_classes(words, lengths, dictionary), "bytes": np.add.reduceat(size, np.cumsum(lengths) - lengths),
                "packed": codec.compress(place[words].astype(np.uint32).tobytes(), asbytes=True), "chunks": begins, "contexts": np.unique(contexts, return_inverse=True)[1], "hashes": hashes,
            }
            yield pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)
            block += 1

    return run


_LISTS = {"doc_ids": pa.int64(), "held_out": pa.bool_(), "sizes": pa.int64(), "kinds": pa.int32(), "bytes": pa.int64(), "chunks": pa.int32(), "contexts": pa.int32(), "hashes": pa.int32()}
BLOCK_SCHEMA = pa.schema([(f.split()[0], pa.list_(_LISTS[f.split()[0]]) if f.split()[0] in _LISTS else pa.binary() if f.startswith("packed") else pa.int64()) for f in BLOCKS.split(", ")])


def _before(flag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item, how many items of its run (which begins at start) come before it, and how many of those have the flag."""
    ones = np.cumsum(flag) - flag
    return np.arange(len(flag)) - start, ones - ones[start]


def stretched(yes: np.ndarray, all_: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
    return np.log((yes + prior) / (all_ - yes + 1 - prior))


def mix_online(text: np.ndarray, token: np.ndarray, kind: np.ndarray, met: np.ndarray, x: np.ndarray, bit: np.ndarray, texts: int) -> np.ndarray:
    """Bits that each decision costs. Decisions come by text and token; x holds their predictors' log odds. Weights and refiners are
    a text's own and are updated after every STEP tokens, all texts side by side."""
    step = token // STEP
    order = np.argsort(step * texts + text, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(step[order]) > 0, [True]])) if len(order) else np.zeros(1, np.int64)
    gate = (kind * 4 + np.minimum(met, 3)).astype(np.int64)
    weights = np.full((texts * GATES, PREDICTORS), FIRST_WEIGHT)
    record = np.zeros((texts * REFINERS, 2))
    cost = np.zeros(len(text))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        slot, xs, y = text[at] * GATES + gate[at], x[at], bit[at]
        odds = np.clip((xs * weights[slot]).sum(1), -12, 12)
        p = 1 / (1 + np.exp(-odds))
        own = text[at] * REFINERS + np.clip(odds * 2 + REFINERS // 2, 0, REFINERS - 1).astype(np.int64)
        refined = (record[own, 1] + PULL * p) / (record[own].sum(1) + PULL)
        final = (p + refined) / 2
        cost[at] = -np.log2(np.where(y, final, 1 - final))
        np.add.at(weights, slot, PACE * (y - p)[:, None] * xs)
        np.add.at(record, (own, y.astype(np.int64)), 1)
    return cost


def text_bits(codes: np.ndarray, sizes: np.ndarray, p: np.ndarray, known: np.ndarray, spelled: np.ndarray, new_rate: float, sort: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: tuple[np.ndarray, ...]) -> np.ndarray:
    """Bits of each text. p: every token's chance by counts; known: whether it has one; spelled: the log2 chance of its spelling;
    sort: see in_text; chunk: begins, how often they were foretold aright, out of how many, and whether they come."""
    order, first, earlier = sort
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(codes)) - start
    seen = earlier > 0
    mass = np.cumsum(np.where(seen, 0, p)) - np.where(seen, 0, p)
    mass = np.clip(mass - mass[start], 0, 0.999)
    here = (earlier + PULL * p) / (place + PULL * np.maximum(mass, 1e-9))
    symbol = np.where(seen, np.log2(np.maximum(here, 1e-300)), np.where(known, np.log2(np.maximum(p, 1e-300) / (1 - mass)), spelled))
    # decisions seen, of every token, and known, of those that are new
    past = np.zeros(len(codes), np.int64)
    for back in (1, 2):
        flag = np.zeros(len(codes), np.int64)
        flag[back:] = seen[:-back]
        past += np.where(place >= back, flag << (back - 1), 0)
    before = np.full(len(codes), -1)  # the place in sort order of the token before
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.arange(len(codes))
    before[1:] = rank[:-1]
    before[place == 0] = -1
    x, met = [], np.zeros((2, len(codes)), np.int64)
    for kind, flag, valid, prior in ((SEEN, seen, np.ones(len(codes), bool), 0.5), (KNOWN, known, ~seen, 1 - new_rate)):
        count = lambda value, begin: (lambda v: (v - v[begin]))(np.cumsum(value) - value)
        yes = flag & valid
        inputs = [stretched(count(yes, start), count(valid, start), prior)]
        n, y = np.zeros(len(codes)), np.zeros(len(codes))
        for h in range(4):
            at = past == h
            n[at], y[at] = count(valid & at, start)[at], count(yes & at, start)[at]
        inputs.append(stretched(y, n, prior))
        # tokens in sort order stand for the token after each, if it is of the same text
        follows = np.append(order + 1, 0)[: len(order)]
        good = (follows < len(codes)) & (np.append(place, 0)[follows] > 0)
        v, w = np.where(good, np.append(valid, False)[follows], False), np.where(good, np.append(yes, False)[follows], False)
        n, y = count(v, first), count(w, first)
        n, y = np.where(before >= 0, n[before], 0), np.where(before >= 0, y[before], 0)
        met[kind] = n
        inputs.append(stretched(y, n, prior))
        far = start + np.where(place > 0, (1 << np.floor(np.log2(np.maximum(place, 1))).astype(np.int64)), 0)
        inputs.append(stretched(count(yes, far), count(valid, far), prior))
        x.append(np.stack(inputs, 1))
    begins, good, tries, comes = chunk
    told = np.flatnonzero(good > 0)
    of = text[begins[told]]
    run = np.searchsorted(of, of)
    n, y = _before(comes[told], run)
    last = np.where(n > 0, np.where(np.append(False, comes[told][:-1])[: len(told)], 1.0, -1.0), 0.0)
    foretold = np.stack([np.log((good[told] + 0.4) / (tries[told] - good[told] + 0.4)), stretched(y, n, 0.5), last, np.ones(len(told))], 1) if len(told) else np.zeros((0, PREDICTORS))
    new = np.flatnonzero(~seen)
    token = np.concatenate([place, place[new], place[begins[told]]])
    cost = mix_online(np.concatenate([text, text[new], of]), token, np.repeat([SEEN, KNOWN, REPEATED], [len(codes), len(new), len(told)]), np.concatenate([met[SEEN], met[KNOWN][new], n]), np.concatenate([x[0], x[1][new], foretold]), np.concatenate([seen, known[new], comes[told]]), len(sizes))
    each = cost[: len(codes)] - symbol
    each[new] += cost[len(codes) : len(codes) + len(new)]
    width = np.diff(np.append(begins, len(codes)))
    each[np.repeat((good > 0) & comes, width)] = 0
    return np.bincount(text, each, len(sizes)) + np.bincount(of, cost[len(codes) + len(new) :], len(sizes))


def in_text(text: np.ndarray, codes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """((order, first, earlier), own): the tokens in order of text, code and place; in that order, where a token's equals begin; and of
    each token how many equals come before it in its text, and how many there are."""
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(order)]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    earlier, own = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    earlier[order] = np.arange(len(order)) - first
    own[order] = np.bincount(first, minlength=len(order))[first]
    return (order, first, earlier), own


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, codec = model.value, pa.Codec("zstd")
        norm, tokens_of = m.n + 0.5 * (m.v + 1), np.maximum(m.class_tokens, 1)
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                held, sizes, kinds, n_bytes, begins, contexts, hashes = (row.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5, 7, 8, 9))
                rare, chunks = row.column(10).flatten(), row.column(11).flatten()
                codes = np.frombuffer(codec.decompress(row.column(6)[0].as_py(), 4 * int(sizes.sum()), asbytes=True), np.uint32).astype(np.int64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                counts = np.concatenate([m.counts, pc.fill_null(rare.field("c"), 0).to_numpy(zero_copy_only=False)])
                c = counts[codes]
                base = np.bincount(text, np.log10((c + 0.5) / norm), len(sizes))
                sort, own = in_text(text, codes)
                trained = ~held.astype(bool)[text]
                left = c - np.where(trained, own, 0)
                kind = kinds[text]
                in_class, classed = np.zeros(len(codes), np.int64), codes < len(m.by)
                in_class[classed] = m.by[codes[classed], kind[classed]]
                keys, found = (np.concatenate(pair) for pair in zip((m.keys, m.in_class), class_keys(rare.field("by"), len(m.words)), strict=True))
                asked = codes[~classed] * CLASSES + kind[~classed]
                at = np.searchsorted(keys, asked)
                in_class[~classed] = np.where(np.append(keys, -1)[at] == asked, np.append(found, 0)[at], 0)
                in_class = np.maximum(in_class - np.where(trained, own, 0), 0)
                p = OWN_SHARE * in_class / tokens_of[kind] + (1 - OWN_SHARE) * left / max(m.n, 1)
                known = left > 0
                spelled = np.full(len(codes), -1.0)
                odd = np.flatnonzero(~known & (sort[2] == 0))
                numbers, back = np.unique(codes[odd], return_inverse=True)
                few = numbers >= len(m.words)
                spellings = np.empty(len(numbers))
                spellings[~few] = m.word_log2(m.words.take(pa.array(numbers[~few])))
                spellings[few] = m.word_log2(rare.field("word").take(pa.array(numbers[few] - len(m.words))))
                spelled[odd] = spellings[back]
                # what foretells each chunk, without the text's own part in it
                of = text[begins] if len(begins) else begins
                told = np.full(int(contexts.max(initial=-1)) + 1, -1)
                told[chunks.field("k").to_numpy()] = np.arange(len(chunks))
                at = told[contexts]
                total, best, best_c = (np.append(chunks.field(f).to_numpy(), 0)[at] for f in ("total", "best", "best_c"))
                comes = (hashes == best) & (at >= 0)
                pair = of * len(told) + contexts
                _, place = np.unique(pair, return_inverse=True)
                mine, hits = np.bincount(place)[place], np.bincount(place, comes)[place]
                training = ~held.astype(bool)[of]
                good, tries = np.where(at >= 0, best_c - np.where(training, hits, 0), 0), total - np.where(training, mine, 0)
                first = np.log2((m.class_texts + 0.5) / (m.class_texts.sum() + 0.5 * CLASSES))[kinds]
                bits = text_bits(codes, sizes, p, known, spelled, m.new_rate, sort, (begins, good, tries, comes)) - first
                yield pa.RecordBatch.from_arrays(
                    [row.column(1).flatten(), pa.array(held.astype(bool)), pa.array(sizes), pa.array(np.bincount(text, c > 0, len(sizes)).astype(np.int64)), pa.array(np.full(len(sizes), m.n)), pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / n_bytes)],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    counts = token_counts(docs, id_col, text_col)
    model = spark.sparkContext.broadcast(fit(counts))
    given = docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string"))
    asked = given.mapInArrow(_ask(model), "block long, k int, word string").join(counts.select("word", "c", _by_class().alias("by")), "word", "left")
    rare = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "word", "c", "by"))).alias("rare"))
    found = saved(given.mapInArrow(_chunks, "block long, k int, context long, chunk int, c int, need int"), "chunks", compression="zstd")
    told = found.where("k >= 0").select("block", "k", "context", "need").join(chunk_table(found), "context").where("total >= need")
    chunks = told.groupBy("block").agg(F.collect_list(F.struct("k", F.col("total").cast("long").alias("total"), "best", F.col("best_c").cast("long").alias("best_c"))).alias("told"))
    rows = given.mapInArrow(_blocks(model), BLOCKS).join(rare, "block", "left").join(chunks, "block", "left")
    none = lambda name, of: F.coalesce(name, F.expr(f"cast(array() AS array<struct<{of}>>)")).alias(name)
    whole = rows.select(*[f.split()[0] for f in BLOCKS.split(", ")], none("rare", "k: int, word: string, c: long, by: array<long>"), none("told", "k: int, total: long, best: int, best_c: long"))
    return whole.mapInArrow(_score(model), RESULT)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
