"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit for each of 64 positions, set if it is set in over half the hashes of the text's word shingles. Equal
fingerprints are one; pairs of distinct ones are found by their distances to reference fingerprints (pivots):

* The 64 positions are dealt to three regions, each with pivots that differ from zero inside the region alone. The table holds
  every fingerprint's Hamming distances to zero and to all pivots. A distance to a pivot, less that to zero, depends on the
  region's bits only. Two fingerprints that differ in at most two positions leave one region untouched, so all their coordinates
  there agree: that is the equi-join key.
* Of the pairs that share a key, those with a coordinate anywhere on the table that differs by more than two are discarded: a
  distance to a pivot can't change by more than the distance between the two.
* Survivors are verified by their exact distance.

A bucket of more than BUCKET fingerprints is split anew by the positions that it doesn't fix, again in three regions with pivots
of their own, until it is small enough; no pair is lost, since the two positions leave one of three untouched at every depth. So
no bucket's pairs grow with the square of a hot group.

drop_near_copies takes the pairs that these tables find; since fingerprints of 64 bits tell near copies of a few edits apart by more
bits than any such table can search, it adds those that the wider fingerprints of riskloom.llm.similar find, verifies all of them
on whole texts and keeps one row of each component.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle make one
shingle; repeated rows get a row each; a null doc_id is never a component's smallest unless there is no other; an empty table
gives an empty result; extra columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import read_table, saved, text_batches
from riskloom.llm.components import components
from riskloom.llm.similar import SIMILAR, similar_pairs

SHINGLE, SEED, MOST_BITS = 3, 42, 2
BUCKET, REGIONS, PIVOTS = 64, 3, 16
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
COLUMN = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.bincount((hashes + COLUMN).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(t) for t in texts], pa.int64())], ["doc_id", "fp"])


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def split_positions(positions: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The positions dealt to regions in turn."""
    return [positions[k::REGIONS] for k in range(REGIONS)]


def region_pivots(region: tuple[int, ...]) -> list[int]:
    """Reference fingerprints that differ from zero inside the region alone: of a small region its first one, two, ... positions,
    so that the distances tell all its bits; else PIVOTS random sets of half its positions."""
    if len(region) < 16:
        return [sum(1 << j for j in region[: k + 1]) for k in range(len(region))]
    rnd = random.Random(region[0] + 64 * len(region))
    return [sum(1 << j for j in rnd.sample(region, len(region) // 2)) for _ in range(PIVOTS)]


TABLE = [(0, m) for m in [0]] + [(k + 1, m) for k, region in enumerate(split_positions(tuple(range(64)))) for m in region_pivots(region)]  # region (0: none), pivot


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(pivot))))


def coordinates(to_zero: Column, to_pivots: list[tuple[int, Column]]) -> Column:
    """One number of a region's coordinates: the distances to its pivots less the distance to zero, which is what the fingerprint
    has outside the region in common; halved, they take four bits each."""
    key = F.lit(0).cast("long")
    for k, (pivot, to_pivot) in enumerate(to_pivots):
        inside = F.shiftright((to_zero + F.lit(pivot.bit_count()) - to_pivot).cast("long"), 1)
        key = key.bitwiseOR(F.shiftleft(inside, 4 * k))
    return key


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps (column fp) with d, the distances to the pivots of TABLE."""
    return fps.withColumn("d", F.array(*[distance(F.col("fp"), m).cast("byte") for _, m in TABLE]))


def candidates(keyed: DataFrame) -> DataFrame:
    """(a, b, apart) of pairs with equal coordinates in a region (path and fixed): apart is their largest coordinate difference on the whole table."""
    left = keyed.select(F.col("fp").alias("a"), F.col("d").alias("da"), "path", "fixed")
    right = keyed.select(F.col("fp").alias("b"), F.col("d").alias("db"), "path", "fixed")
    apart = F.greatest(*[F.abs(F.col("da")[i] - F.col("db")[i]) for i in range(len(TABLE))])
    same = (left["path"] == right["path"]) & (left["fixed"] == right["fixed"]) & (F.col("a") < F.col("b"))
    return left.join(right, same).select("a", "b", apart.alias("apart"))


def first_keys(table: DataFrame) -> DataFrame:
    """A row for each region of all positions: path names the region, fixed holds the coordinates in it."""
    keys = []
    for k in range(REGIONS):
        to = [(m, F.col("d")[i].cast("int")) for i, (r, m) in enumerate(TABLE) if r == k + 1]
        keys.append(F.struct(F.lit(str(k)).alias("path"), F.array(coordinates(F.col("d")[0].cast("int"), to)).alias("fixed")))
    return table.select("fp", "d", F.explode(F.array(*keys)).alias("k")).select("fp", "d", "k.path", "k.fixed")


def free_positions(path: str) -> tuple[int, ...]:
    """The positions outside the regions that path names, one in each split."""
    free = tuple(range(64))
    for k in path:
        region = split_positions(free)[int(k)]
        free = tuple(j for j in free if j not in region)
    return free


def _more_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of full buckets, once for each region of the positions that their path leaves free, with the coordinates there."""
    pivots: dict[str, list[list[int]]] = {}
    for batch in batches:
        paths, prints = np.array(batch.column(2).to_pylist()), batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        for path in np.unique(paths).tolist():
            at = np.flatnonzero(paths == path)
            part, fps = batch.take(pa.array(at)), prints[at]
            to_zero = np.bitwise_count(fps).astype(np.int64)
            if path not in pivots:
                pivots[path] = [region_pivots(region) for region in split_positions(free_positions(path))]
            for k, masks in enumerate(pivots[path]):
                key = np.zeros(len(fps), np.int64)
                for i, m in enumerate(masks):
                    key |= (to_zero + m.bit_count() - np.bitwise_count(fps ^ np.uint64(m)).astype(np.int64) >> 1) << (4 * i)
                fixed = pa.array([[*f, x] for f, x in zip(part.column(3).to_pylist(), key.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f"{path}{k}"] * len(fps)), fixed], ["fp", "d", "path", "fixed"])


def near_pairs(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b, of all distinct fingerprints in column fp that differ in at most MOST_BITS positions."""
    keyed, found, free = saved(first_keys(pivot_table(fps.select("fp"))), "buckets"), None, 64
    while True:
        free -= free // REGIONS
        most = bucket if free >= 2 * REGIONS else 1 << 62  # what can't be split further is small
        sizes = saved(keyed.groupBy("path", "fixed").count().where("count > 1"), "bucket-sizes")
        small = keyed.join(sizes.where(F.col("count") <= most).select("path", "fixed"), ["path", "fixed"], "left_semi")
        near = candidates(small).where(F.col("apart") <= MOST_BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")
        found = near if found is None else found.unionByName(near)
        large = sizes.where(F.col("count") > most)
        if large.isEmpty():
            return found.distinct()
        full = keyed.join(large.select("path", "fixed"), ["path", "fixed"], "left_semi").select("fp", "d", "path", "fixed")
        keyed = saved(full.mapInArrow(_more_keys, keyed.schema), "buckets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = saved(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_pairs(distinct.select("fp")))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    linked = saved(linked, "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    places = linked.join(least, "root").select("fp", "component_id")
    return prints.join(places, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, of rows (_row, text): each row with the first of its fingerprint, and the first rows of fingerprints that the pivot
    tables link."""
    prints = saved(rows.select("_row", "text").mapInArrow(_fingerprints, "doc_id long, fp long").withColumnRenamed("doc_id", "_row"), "near-prints")
    first = saved(prints.groupBy("fp").agg(F.min("_row").alias("a")), "near-firsts")
    equal = prints.join(first, "fp").where("_row <> a").select("a", F.col("_row").alias("b"))
    linked = near_pairs(first.select("fp")).withColumnsRenamed({"a": "fp", "b": "fq"})
    both = linked.join(first, "fp").join(first.select(F.col("fp").alias("fq"), F.col("a").alias("b")), "fq")
    return equal.unionByName(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row of each component of similar texts: that of the smallest id, a null id last. Rows are told apart by a number of
    their own, since ids may be shared by rows of other components, or by several of one."""
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows", compression="zstd")
    texts = rows.select("_row", F.col(text_col).cast("string").alias("text"))
    roots = components(similar_pairs(texts, least, fingerprint_pairs(texts)))
    members = roots.select(F.col("node").alias("_row"), "root").unionByName(roots.select(F.col("root").alias("_row"), "root").distinct())
    grouped = rows.select("_row", id_col).join(members, "_row")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col), "_row"))["_row"]
    kept = grouped.groupBy("root").agg(first.alias("_row")).select("_row", F.lit(True).alias("_kept"))
    gone = grouped.select("_row").join(kept, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
