"""Exact top-k search over 64-bit codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orospark.llm.common import discard, materialise, table

BITS = 64
TOP = 10
#: Every so many ids are queries.
EVERY = 50
#: Entries of a bucket, at least, over which it is split; and there are at most so many split buckets.
BUCKET_ROWS, HOT_BUCKETS = 50_000, 20_000


def sign_code(vector: str) -> Column:
    """Bit i is set where entry i (of the first 64) is over 0; null, NaN and missing entries leave it clear."""
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x) & (i < BITS), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.col(vector), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(n_codes: int) -> list[tuple[int, int]]:
    """(first bit, length) of each segment: a few bits less than log2 of the number of codes, so a bucket holds about six
    codes, which is less work than probing six times the buckets."""
    m = min(8, max(2, round(BITS / max(8.0, math.log2(max(n_codes, 2)) - 2.5))))
    cuts = [round(BITS * k / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(code: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << length) - 1))


def _masks(length: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(length), radius)], np.int64)


def _probes(queries: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(bucket, q): buckets at exactly the radius from each segment of each query code."""

    def run(batches):
        masks = [_masks(length, radius) for _, length in parts]
        block = max(1, 200_000 // max(1, max(map(len, masks))))
        for b in batches:
            for at in range(0, b.num_rows, block):
                q = b.slice(at, block).column(0).to_numpy()
                for s, (first, length) in enumerate(parts):
                    own = (q.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << length) - 1)
                    if len(masks[s]):
                        yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ masks[s]).ravel() | (s << 40)), pa.array(np.repeat(q, len(masks[s])))], names=["bucket", "q"])

    return queries.select("q").mapInArrow(run, "bucket long, q long")


def _split(index: DataFrame, n_entries: int, bucket_rows: int) -> DataFrame | None:
    """(bucket, parts) of the buckets with so many entries that one task shouldn't meet them alone: HOT_BUCKETS at most."""
    most = max(bucket_rows, n_entries // HOT_BUCKETS)
    hot = index.groupBy("bucket").count().where(F.col("count") > most).select("bucket", F.ceil(F.col("count") / most).cast("int").alias("parts")).collect()
    return index.sparkSession.createDataFrame([tuple(r) for r in hot], "bucket long, parts int") if hot else None


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, parts: list[tuple[int, int]] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest of rows (vec_id, code) for each of queries (query_id, code), ties by vec_id.

    Equal codes are one entry of the index, with their number and k least ids (kept in each task before any meet, so a code
    that a third of all rows have is no burden); equal queries are searched for once. In round r the buckets at radius r of
    every segment are probed; each candidate counts in the first (radius, segment) that meets it, so none comes twice. A
    code not met by then differs from the query in r + 1 bits of each segment; a query is done when its kth verified
    distance is below that sum. A bucket with very many codes is split, and its probes go to all parts.

    Rows and queries with a null code are left out, a null id counts as the least; repeated rows count each, repeated
    queries get rows each; with fewer than k rows all are returned, of empty tables none; further columns are ignored."""
    rows = rows.where("code is not null").select("vec_id", "code")
    queries = queries.where("code is not null").select("query_id", "code")
    counts = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    first_ids = rows.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("_r") <= k).select("code", "vec_id")
    codes = materialise(counts)
    n_codes, n_rows = codes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = parts or segments(n_codes)
    buckets = F.explode(F.array(*[_segment(F.col("code"), a, b).bitwiseOR(F.lit(s << 40)) for s, (a, b) in enumerate(parts)]))
    index = materialise(codes.select(buckets.alias("bucket"), "code", "n"))
    hot = _split(index, n_codes * len(parts), bucket_rows)
    on = ["bucket"]
    if hot is not None:
        on, one = ["bucket", "part"], F.coalesce("parts", F.lit(1))
        index = index.join(F.broadcast(hot), "bucket", "left").withColumn("part", F.pmod(F.xxhash64("code"), one).cast("int")).drop("parts")
    asked = queries.groupBy("code").count().select(F.col("code").alias("q"))
    left = materialise(asked)
    want, found, tallies, done, steps = min(k, n_rows), [], [], [], [codes]
    for radius in range(max(b for _, b in parts) + 1):
        if not want or left.isEmpty():
            break
        x = F.col("q").bitwiseXOR(F.col("code"))
        apart = [F.bit_count(_segment(x, a, b)) for a, b in parts]
        met = F.shiftright("bucket", 40)
        before = [(apart[s] > radius) | (met <= s) for s in range(len(parts))]
        after = [(apart[s] >= radius) | (met >= s) for s in range(len(parts))]
        probes = _probes(left, parts, radius)
        if hot is not None:
            probes = probes.join(F.broadcast(hot), "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
        near = probes.hint("merge").join(index.hint("merge"), on).where(reduce(Column.__and__, before + after))
        near = materialise(near.select("q", "code", "n", F.bit_count(x).alias("d")))
        found.append(near)
        tallies.append(near.groupBy("q", "d").agg(F.sum("n").alias("n")))
        tally = reduce(DataFrame.union, tallies).groupBy("q", "d").agg(F.sum("n").alias("n"))  # at most 65 rows for each query
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("d"))
        kth = tally.withColumn("upto", upto).where(F.col("upto") >= want).groupBy("q").agg(F.min("d").alias("kth"))
        sure = materialise(kth.where(F.col("kth") < len(parts) * (radius + 1)).join(left, "q", "left_semi"))
        done.append(sure)
        steps.append(left)
        left = materialise(left.join(sure, "q", "left_anti"))
    if not found:
        return queries.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).alias("distance")).where("false")
    bound = reduce(DataFrame.union, done)
    near = reduce(DataFrame.union, found).join(bound, "q").where("d <= kth").select("q", "code", "d")
    order = Window.partitionBy("q").orderBy("d", "vec_id")
    best = near.join(first_ids, "code").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "vec_id", F.col("d").alias("distance"))
    best = materialise(best)
    discard(left, *steps, *found, *done)
    return queries.withColumnRenamed("code", "q").join(best, "q").select("query_id", "rank", "vec_id", "distance")


def op2_hamming_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten nearest codes of each embedding whose id is divisible by 50; odd rows as in top_k(); a null embedding has no code."""
    rows = materialise(table(spark, sf_dir, "embeddings").select("vec_id", sign_code("embedding").alias("code")))
    queries = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "code")
    return top_k(rows, queries)


OP2_SQL = f"""
with c as (select vec_id, embedding as e from embeddings where embedding is not null),
bits as (select vec_id, unnest(range({BITS})) as i, e from c),
codes as (select vec_id, list(case when e[i + 1] > 0 then 1 else 0 end order by i) as b from bits group by vec_id),
d as (
  select q.vec_id as query_id, r.vec_id,
         list_sum(list_transform(list_zip(q.b, r.b), lambda p: case when p[1] <> p[2] then 1 else 0 end))::int as distance
  from codes q, codes r where q.vec_id % {EVERY} = 0
),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from d)
select query_id, rank, vec_id, distance from ranked where rank <= {TOP}
"""
