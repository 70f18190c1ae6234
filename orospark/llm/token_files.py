"""Token ids in Parquet list columns, laid out for selective reads of tokens and metadata."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import FEW_ROWS, READER_ROWS, dealt_by_range, give_memory_back, map_texts, materialise, new_path, parts_for, smaller_batches, start_task, table
from orospark.llm.tokens import BATCH_BYTES, ENCODERS, encoder, tokenizer_path, with_end

BYTE_BPE = "byte_bpe_50k.json"
#: Dictionary pages for ids (a vocabulary of 50k fits in one), delta for the metadata; the v2 writer adds page
#: indexes, so a reader skips the pages of other documents.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


#: Text of a range partition, and so of a file, about.
PART_BYTES = 64 << 20


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of the texts: as planned from the size of the files that they are read from, three times that for compression;
    counted where the plan doesn't know."""
    planned = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 3 * planned if planned < 1 << 60 else docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def encode_documents(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs in ascending key order (a null key first, equal keys by text) with ids, n_tokens, part and local_start.

    A null or empty text has the end id only; very long texts are encoded whole; repeated rows follow one another; other
    columns of docs stay, but those that clash go; an empty table stays empty."""
    long = T.LongType()
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", long), T.StructField("part", T.IntegerType()), T.StructField("local_start", long)]
    dealt = dealt_by_range(docs, [key, F.xxhash64(text)], parts_for(docs.sparkSession, text_bytes(docs, text), PART_BYTES))

    def make():
        encode, part, before = encoder(path).encode, TaskContext.get().partitionId(), 0

        def f(texts):
            nonlocal before
            ids, ends = with_end(*encode(texts), end_id)
            n = np.diff(ends)
            start = before + ends[:-1]
            before += int(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            return [lists, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(start)]

        return f

    return map_texts(dealt, make, fields, text, keep_text=False, limit=BATCH_BYTES, keep=ENCODERS, arrow=True)


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id", layout: dict[str, str] | None = None) -> None:
    """Encode docs and write them to the folder out; files and their rows are in ascending key order."""
    with smaller_batches(docs.sparkSession, FEW_ROWS, READER_ROWS):
        encode_documents(docs, path, end_id, text, key).write.options(**(layout or LAYOUT)).parquet(out)


def read_index(spark, out: str, key: str = "doc_id") -> DataFrame:
    """Key, start and n_tokens of each document, from the metadata columns only."""
    rows = spark.read.parquet(out).select(key, "part", "local_start", "n_tokens")
    return with_starts(rows)


def file_starts(rows: DataFrame) -> DataFrame:
    """part and the ids before it; one sum for each file reaches the driver."""
    sums, before, offsets = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n")).collect(), 0, []
    for r in sorted(sums):
        offsets.append((r.part, before))
        before += r.n
    return rows.sparkSession.createDataFrame(offsets, "part int, _before long")


def with_starts(rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """rows of token files with start: ids of all documents before."""
    small = file_starts(rows if metadata is None else metadata)
    return rows.join(F.broadcast(small), "part", "left").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def read_tokens(spark, out: str, keys: list[int] | None = None, key: str = "doc_id") -> DataFrame:
    """Key and ids of all documents, or of those with the keys given: the filter reaches row groups and pages."""
    rows = spark.read.parquet(out).select(key, "ids")
    return rows if keys is None else rows.where(F.col(key).isin(keys))


def id_checksums(spark, out: str, key: str = "doc_id") -> DataFrame:
    """key, part, local_start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files.

    Spark's Parquet reader splits files between row groups and streams their rows, so no file is too large."""
    rows = spark.read.parquet(out).select(key, "part", "local_start", "n_tokens", "ids")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        start_task()  # the files are written: no encoder needed
        for rows in batches:
            lists = rows.column(4)
            ends = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(crc, pa.int64())], names=schema.names)
        give_memory_back()

    return rows.mapInArrow(run, schema)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the files; odd rows as in encode_documents()."""
    out = new_path(spark)
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), out, tokenizer_path(BYTE_BPE))
    with smaller_batches(spark, FEW_ROWS, READER_ROWS):  # so the files are read here, and the result from narrow rows
        checked = materialise(id_checksums(spark, out))
    return with_starts(checked).select("doc_id", "start", "n_tokens", "ids_crc32")
