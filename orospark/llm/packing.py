"""Best-fit-decreasing packing of token sequences into windows, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import RANGE_ROWS, discard, give_memory_back, global_rank, materialise, parts_for, slices, smaller_batches, start_task, table, without
from orospark.llm.tokens import BATCH_BYTES, ENCODERS, encoder, tokenizer_path, with_end

WORD_BPE = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2


class CapacityTree:
    """Segment tree over remaining capacities: marks those with an open window, finds the least at or above a length."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def mark(self, capacity: int, there: bool) -> None:
        at = capacity + self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Where best-fit decreasing puts pieces, given how many there are of each length.

    Rows (first, sequence, offset), by first: of the pieces in order of falling length, those from the number
    first on (to the next row's) go to sequences counting up from sequence, at offset. Windows of equal
    capacity are handled as runs, so time and plan depend on the window, not on the number of pieces.
    Returns the rows and the number of sequences."""
    tree, open_runs = CapacityTree(window), [deque() for _ in range(window + 1)]
    plan: list[tuple[int, int, int]] = []
    rank = bins = 0

    def leave(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs[capacity].append((first, n))
            tree.mark(capacity, True)

    def fill(first: int, n: int, capacity: int, length: int, each: int) -> None:
        nonlocal rank
        for k in range(each):
            plan.append((rank, first, window - capacity + k * length))
            rank += n
        leave(capacity - each * length, first, n)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} tokens")
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, bins
                n = -(-left // (window // length))
                bins += n
            else:
                first, n = open_runs[capacity].popleft()
                if not open_runs[capacity]:
                    tree.mark(capacity, False)
            each = capacity // length  # the window just used stays the tightest while the length fits
            full, rest = min(n, left // each), 0
            if full:
                fill(first, full, capacity, length, each)
            left -= full * each
            used = full
            if used < n and left and left < each:
                rest, left, used = left, 0, used + 1
                fill(first + full, 1, capacity, length, rest)
            if capacity < window or used < n:
                leave(capacity, first + used, n - used)
    return np.asarray(plan, np.int64).reshape(-1, 3), bins


def cut_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens (and ids). Documents of over a window are first cut into full windows.

    A null or empty text has the end id only, so each document has at least one piece; repeated rows have theirs each, null
    keys stay null; other columns of docs go."""
    long = T.LongType()
    schema = T.StructType([docs.schema[key], *(T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        start_task(ENCODERS)
        encode = encoder(path).encode
        for batch in batches:
            for rows, texts in slices(batch, text, BATCH_BYTES, arrow=True):
                ids, ends = with_end(*encode(texts), end_id)
                n = np.diff(ends)
                pieces = -(-n // window)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, n[row] - start)
                at, data = ends[row] + start, memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                keys = rows.column(rows.schema.get_field_index(key))
                columns = [keys.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[row]))]
                if with_ids:  # the pieces follow one another in ids
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_memory_back()

    return docs.select(key, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """pieces (length from 1 to window) with sequence_id, gapless from 0, and offset.

    Only the histogram of lengths reaches the driver, at most a row for each length. Equal pieces are
    placed by key, start and checksum. An empty table stays empty."""
    pieces = without(pieces, ["sequence_id", "offset", "rank", "_falling"])
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, _ = best_fit_decreasing(counts, window)
    parts = parts_for(pieces.sparkSession, sum(counts.values()), RANGE_ROWS if "ids" not in pieces.columns else RANGE_ROWS // 100)
    ranked = global_rank(pieces.withColumn("_falling", -F.col("length")), ["_falling", key, "start", "ids_crc32"], "rank", parts).drop("_falling")
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # bounded by the window: see best_fit_decreasing
    long = T.LongType()
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", long), T.StructField("offset", long)])

    def place(batches):
        plan = shared.value
        for b in batches:
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            row = plan[np.searchsorted(plan[:, 0], rank, "right") - 1] if len(rank) else plan[:0]
            old = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in old), pa.array(row[:, 1] + rank - row[:, 0]), pa.array(row[:, 2])], names=[*old, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces of docs with their places; the texts are encoded once. Odd rows as in cut_documents() and pack()."""
    with smaller_batches(docs.sparkSession):
        pieces = materialise(cut_documents(docs, path, window, end_id, text, key))
    placed = pack(pieces, window, key)
    discard(pieces)
    return placed


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): token ids of each sequence, padded to the window (not where its length is a power of two).

    placed comes from pack() of pieces with ids (see cut_documents): pieces carry their ids along, so null and repeated keys
    are as good as any. A sequence holds at most window pieces, so no group is unbounded."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    whole = placed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))
    exact = F.bit_count("n_tokens") == 1
    return whole.withColumn("ids", F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.col("n_tokens").cast("int")))))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of each document with their places; odd rows as in cut_documents() and pack()."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
