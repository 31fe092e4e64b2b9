"""Exact dedup by distributed most-significant-digit radix partitioning.

Texts are compared by their bytes after lower-casing A-Z; no digest decides equality. A digit is a run of successive bytes,
and digits grow with the depth.

* Inside a task, blocks of bounded size are split digit by digit until groups are singletons or ended, so that a block sends on
  one row for each distinct text of its own, however many copies a block holds.
* Over all tasks, the blocks' rows are then split the same way: at each depth, rows of a group are counted by their next digit
  (partial counts before the shuffle). Groups of one row are done; so are groups whose texts ended inside the digit, which are
  equal. The rest are split by the digit after it. A hot text has one row for each block at most.

Defined cases: null texts count as empty, and empty texts are equal; a null doc_id stays only where its group has no other; of
several rows with the largest doc_id one stays; an empty table gives an empty result; extra columns, whatever their names, are
carried only where asked for. Texts of any length are compared whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import ascii_lower, read_table, saved

FIRST_DIGIT, DIGIT_GROWTH = 64, 16
BLOCK_BYTES = 24 << 20
#: Columns of a split table, named so that they clash with nothing that is carried along.
ID, GROUP, FIRST, COUNT, BEST, STAYS = "_x_id", "_x_group", "_x_first", "_x_count", "_x_best", "_x_stays"


def radix_groups(texts: list[bytes], digit: int = FIRST_DIGIT) -> list[list[int]]:
    """Indexes of equal texts, split by successive runs of bytes."""
    done, open_groups = [], [(0, digit, list(range(len(texts))))]
    while open_groups:
        at, size, members = open_groups.pop()
        if len(members) == 1:
            done.append(members)
            continue
        by_digit = defaultdict(list)
        for i in members:
            by_digit[texts[i][at : at + size]].append(i)
        for bytes_here, part in by_digit.items():
            if len(bytes_here) < size:
                done.append(part)
            else:
                open_groups.append((at + size, size * DIGIT_GROWTH, part))
    return done


def _split_blocks(schema: T.StructType, id_at: int, text_at: int, drop_copies: bool):
    def block(batches: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(batches).combine_chunks()
        texts = [(t or "").encode().lower() for t in table.column(text_at).to_pylist()]
        ids = table.column(id_at).to_pylist()
        n = len(texts)
        group, is_first, count, best, stays = [0] * n, [False] * n, [None] * n, [None] * n, [False] * n
        groups = radix_groups(texts)
        for k, members in enumerate(groups):
            winner = max(members, key=lambda i: (ids[i] is not None, ids[i] or 0, -i))
            for i in members:
                group[i] = first + k
            is_first[winner], count[winner], best[winner], stays[winner] = True, len(members), ids[winner], True
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        if drop_copies:  # a copy's text is that of its group's row
            columns[text_at] = pa.array([t if keep else None for t, keep in zip(columns[text_at].to_pylist(), is_first, strict=True)], columns[text_at].type)
        columns += [pa.array(group, pa.int64()), pa.array(is_first), pa.array(count, pa.int64()), pa.array(best, pa.int64()), pa.array(stays)]
        return pa.RecordBatch.from_arrays(columns, schema.names), first + len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text_at).nbytes
            if size >= BLOCK_BYTES:
                out, first = block(held, first)
                held, size = [], 0
                yield out
        if held:
            yield block(held, first)[0]

    return run


def split_rows(docs: DataFrame, id_col: str, text_col: str, whole_rows: bool) -> DataFrame:
    """The rows of docs with their block groups, as a written table. whole_rows: all columns stay as they are; else only id and text do, and a text only where it is its group's."""
    columns = docs.columns if whole_rows else [id_col, text_col]
    given = docs.select(*columns, F.col(id_col).cast("long").alias(ID))
    schema = T.StructType([*given.schema, *T._parse_datatype_string(f"{GROUP} long, {FIRST} boolean, {COUNT} long, {BEST} long, {STAYS} boolean")])
    run = _split_blocks(schema, len(columns), columns.index(text_col), not whole_rows)
    return saved(given.mapInArrow(run, schema), "radix-blocks", compression="zstd")


def equal_groups(rows: DataFrame, text_col: str) -> DataFrame:
    """(GROUP, root): the block groups, each with the least of those that hold an equal text. One job a depth, over what is not told apart yet."""
    text = F.encode(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "UTF-8")
    firsts = rows.where(FIRST).select(GROUP, text.alias("text"))
    active, at, size = firsts.withColumn("parent", F.lit(0).cast("long")), 0, FIRST_DIGIT
    done = None
    while True:
        digit = F.substring("text", at + 1, size)
        keyed = active.withColumn("digit", digit)
        counts = keyed.groupBy("parent", "digit").agg(F.count("*").alias("n"), F.min(GROUP).alias("root")).where("n > 1")
        shared = saved(keyed.join(counts.select("parent", "digit", "root"), ["parent", "digit"]).select(GROUP, "root", "text", (F.length("digit") < size).alias("ended")), "radix-depth", compression="zstd")
        ended = shared.where("ended").select(GROUP, "root")
        done = ended if done is None else done.unionByName(ended)
        active = shared.where("not ended").select(GROUP, "text", F.col("root").alias("parent"))
        if active.isEmpty():
            return done
        at, size = at + size, size * DIGIT_GROWTH


def groups_of(rows: DataFrame, text_col: str) -> DataFrame:
    """(GROUP, keep_id, winner, group_size, sha) of every block group: winner is the block group whose row stays."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    firsts = rows.where(FIRST).select(GROUP, COUNT, BEST, F.sha2(text, 256).alias("sha"))
    rooted = saved(firsts.join(equal_groups(rows, text_col), GROUP, "left").withColumn("root", F.coalesce("root", GROUP)), "radix-roots")
    rank = F.struct(F.col(BEST).isNotNull().alias("known"), F.col(BEST).alias("id"), (-F.col(GROUP)).alias("g"))
    whole = rooted.groupBy("root").agg(F.max(rank).alias("top"), F.sum(COUNT).alias("group_size")).select("root", F.col("top.id").alias("keep_id"), (-F.col("top.g")).alias("winner"), "group_size")
    return rooted.join(whole, "root").select(GROUP, "keep_id", "winner", "group_size", "sha")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: which row of its group stays, the group's size, and the digest of the normalised text."""
    rows = split_rows(docs, id_col, text_col, whole_rows=False)
    found = rows.select(ID, GROUP, STAYS).join(groups_of(rows, text_col), GROUP)
    return found.select(F.col(ID).alias("doc_id"), "keep_id", "group_size", (F.col(STAYS) & (F.col(GROUP) == F.col("winner"))).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = split_rows(docs, id_col, text_col, whole_rows=True)
    stays = groups_of(rows, text_col).where(F.col(GROUP) == F.col("winner")).select(GROUP)
    return rows.where(STAYS).join(stays, GROUP, "left_semi").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (
    SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""
