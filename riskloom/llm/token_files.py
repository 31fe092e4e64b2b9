"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes, written in the order of doc_id.

A token file holds, per document, doc_id, block (the file's place in the order), block_start (ids of the documents before it
in its block), n_tokens, and the list ids. Documents are dealt out by ranges of doc_id, so a block is a range and blocks ascend.
Ids are dictionary-encoded (few distinct values a row group, 16 bits each at most); doc_id, block_start and n_tokens carry no
dictionary and are delta-encoded by the version 2 writer. Row groups are small enough to be read alone, and every page has its
least and greatest doc_id in the page index, so a reader can fetch some documents' tokens, or the metadata alone.

Defined cases: null and empty texts are the end id alone; equal doc_ids lie side by side in any order; null doc_ids come
first; an empty table gives an empty file set; extra columns are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import byte_slices, read_table, scratch_path
from riskloom.llm.wordbpe import encoder, vocabulary_path

END_ID = 1
ENCODED_BYTES = 4 << 20  # of texts encoded at once
ROW_GROUP_BYTES, PAGE_ROWS = 16 << 20, 2000
FILE_BYTES = 256 << 20
FILE_SCHEMA = "doc_id long, block int, block_start long, n_tokens long, ids array<int>"
RESULT = "doc_id long, block int, block_start long, n_tokens long, ids_crc32 long"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, start = encoder(path).encode_texts, TaskContext.get().partitionId(), 0
        for part in byte_slices(batches, 1, ENCODED_BYTES):
            flat, begins = encode(part.column(1), end_id)
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(part.num_rows, block, np.int32)), pa.array(start + begins[:-1]), pa.array(np.diff(begins)), lists],
                ["doc_id", "block", "block_start", "n_tokens", "ids"],
            )
            start += int(begins[-1])

    return run


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encodes docs and writes them to the folder out, in files of about file_bytes of text at most (a document longer than that is in one)."""
    path, spark = path or vocabulary_path(), docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = given.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(_encode(path, end_id), FILE_SCHEMA)
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#block_start": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    files.write.options(**options).parquet(out)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(out)


def read_documents(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """The token rows of some documents: their ids are pushed to the scan, which skips files, row groups and pages by least and greatest doc_id."""
    return read_token_files(spark, out).where(F.col("doc_id").isin(doc_ids))


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """The rows without their ids, which are not read."""
    return read_token_files(spark, out).drop("ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        flat, offsets = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4"), ids.offsets.to_numpy()
        found = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(found, pa.int64())], ["doc_id", "block", "block_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids' crc32 of every document in the files of the folder out. A block's place needs the metadata columns alone."""
    files = read_token_files(spark, out)
    sizes = files.groupBy("block").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    places = sizes.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("place"))
    return files.mapInArrow(_digest, RESULT).join(places, "block").select("doc_id", (F.col("place") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), out)
    return token_digests(spark, out)
