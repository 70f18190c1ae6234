"""Sharding along a Hilbert curve over quantised metadata: shards cover small boxes, so readers can skip files by any dimension."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import RANGE_ROWS, discard, global_rank, materialise, parts_for, table, without

SHARDS = 16
#: Bits of each quantised dimension.
BITS = 12


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of points (n, dimensions), of ``bits`` bits each, by Skilling's transform."""
    n, d = points.shape
    if d * bits > 62:
        raise ValueError("the index has over 62 bits")
    x = points.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        q, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for k in range(d):
            on = (x[k] & q) != 0
            t = (x[0] ^ x[k]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            if k:
                x[k] = np.where(on, x[k], x[k] ^ t)
    for k in range(1, d):
        x[k] ^= x[k - 1]
    t = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        t = np.where((x[d - 1] >> level) & 1, t ^ ((1 << level) - 1), t)
    x ^= t
    out = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(d):
            out = (out << 1) | ((x[k] >> level) & 1)
    return out


def _number(df: DataFrame, name: str, least, most) -> Column:
    """A dimension as a double that keeps its order: strings by six bytes after the prefix common to all, what a double
    holds exactly. Strings equal so far share a cell; the ties of cut_runs() put them in order, nothing is lost."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        skip = len(os.path.commonprefix([(least or "").encode(), (most or "").encode()]))
        part = F.substring(F.col(name).cast("binary"), skip + 1, 6)
        return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def with_hilbert(df: DataFrame, dims: list[str], bits: int = BITS, log_dims: tuple[str, ...] = (), name: str = "hilbert") -> DataFrame:
    """df with the curve index over dims, each cut in 2**bits equal steps from its least to its greatest value
    (log_dims on a log scale). Null and NaN count as the least; of the data only those extremes reach the driver."""
    df = without(df, [name])
    ends = df.agg(*[f(F.col(d)).alias(f"{n}_{k}") for k, d in enumerate(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    numbers = [_number(df, d, ends[f"a_{k}"], ends[f"b_{k}"]) for k, d in enumerate(dims)]
    numbers = [F.log2(F.greatest(c, F.lit(0.0)) + 1) if d in log_dims else c for c, d in zip(numbers, dims, strict=True)]
    numbers = [F.when(F.isnan(c), None).otherwise(c) for c in numbers]
    wide = df.withColumns({f"_d{k}": c for k, c in enumerate(numbers)})
    spans = wide.agg(*[f(F.col(f"_d{k}")).alias(f"{n}{k}") for k in range(len(dims)) for n, f in (("a", F.min), ("b", F.max))]).first()
    low = np.array([spans[f"a{k}"] or 0.0 for k in range(len(dims))])
    span = np.array([spans[f"b{k}"] or 0.0 for k in range(len(dims))]) - low
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for b in batches:
            x = np.stack([b.column(b.schema.get_field_index(f"_d{k}")).to_numpy(zero_copy_only=False).astype(float) for k in range(len(low))], axis=1)
            step = np.where(span > 0, (np.nan_to_num(x, nan=-np.inf) - low) / np.where(span > 0, span, 1) * (1 << bits), 0)
            cell = np.clip(step, 0, (1 << bits) - 1).astype(np.int64)
            old = [n for n in b.schema.names if not n.startswith("_d")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in old), pa.array(hilbert_index(cell, bits))], names=[*old, name])

    return wide.mapInArrow(run, schema)


def cut_runs(df: DataFrame, shards: int = SHARDS, curve: str = "hilbert", ties: tuple[str, ...] = ("doc_id",), parts: int | None = None) -> DataFrame:
    """df with shard and slot: the order along the curve is cut into runs whose counts are at most one apart.

    Rows of one curve index are ordered by ties, so a hot cell is spread over as many shards as it needs."""
    df = without(df, ["shard", "slot", "_rank"])
    ranked = global_rank(df, [curve, *ties], "_rank", parts)
    n = ranked.count()
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")  # the first rank of the shard
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - start).withColumn("shard", F.col("shard").cast("int")).drop("_rank")


def _described(docs: DataFrame, text: str) -> list[Column]:
    """size (UTF-8 bytes plus one) and text_crc32; a null text has size 1 and the checksum of nothing."""
    return [(F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")]


def assign_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Metadata of all docs with curve index, shard and slot, along (lang, source, size, key).

    Equal texts differ in key and maybe source: they go where the curve puts them. Repeated rows are told apart by their
    place only; null keys, langs and sources count as the least; very long texts differ in size only; other columns go; an
    empty table stays empty."""
    dims = [c for c in ("lang", "source") if c in docs.columns]
    narrow = materialise(docs.select(key, *dims, *_described(docs, text)))
    placed = cut_runs(with_hilbert(narrow, [*dims, "size", key], bits, log_dims=("size",)), shards, "hilbert", (key, "text_crc32", "size"), parts_for(docs.sparkSession, narrow.count(), RANGE_ROWS))
    discard(narrow)
    return placed


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write docs as one folder for each shard, each file in slot order, and return each shard's number of rows and extremes
    of the dimensions, for file pruning.

    Rows carry their place along, so null, repeated and equal keys are as good as any; size, text_crc32, hilbert, shard and
    slot replace columns of these names. An empty table writes no shard."""
    dims = [c for c in ("lang", "source") if c in docs.columns]
    rows = without(docs, ["size", "text_crc32", "hilbert", "shard", "slot"])
    rows = rows.select("*", *_described(rows, text))
    placed = cut_runs(with_hilbert(rows, [*dims, "size", key], bits, log_dims=("size",)), shards, "hilbert", (key, "text_crc32", "size"), parts_for(docs.sparkSession, docs.count(), RANGE_ROWS // 100))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
    files = docs.sparkSession.read.schema(placed.schema).parquet(out)
    return files.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *[f(d).alias(f"{n}_{d}") for d in (*dims, "size", key) for n, f in (("min", F.min), ("max", F.max))])


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; odd rows as in assign_shards()."""
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
