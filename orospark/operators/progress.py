"""Progress of jobs as ordered computations over event tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.functions.progress import zoom_percent

# Stages that are timed, with the share of the whole that each is taken to have at first.
DEFAULT_WEIGHTS = {
    "with_publish": {"initializing": 0.02, "gdal_preprocess": 0.23, "ctb_tile": 0.70, "register_tileset": 0.05},
    "without_publish": {"initializing": 0.02, "gdal_preprocess": 0.23, "ctb_tile": 0.75},
}
ALPHA = 0.25
MIN_SAMPLES = 3
MIN_SECONDS, MIN_POINTS = 1.0, 0.5


def monotone(events: DataFrame, job: str, stage: str, percent: str, order: list[str], zoom: tuple[str, str, str] | None = None) -> DataFrame:
    """events with sub_percent: the highest so far in the job's stage, clamped to 100, helped by zooms (current, least, most)."""
    p = F.greatest(F.least(F.col(percent).cast("double"), F.lit(100.0)), F.lit(0.0))
    if zoom:
        p = F.greatest(p, zoom_percent(*[F.col(z) for z in zoom]))
    w = Window.partitionBy(job, stage).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("sub_percent", F.max(p).over(w))


def latest(events: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so no key's rows are gathered."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(key, "_last.*")


def stage_durations(events: DataFrame, job: str, stage: str, ts: str, order: list[str]) -> DataFrame:
    """(job, stage, micros): time from the start of each stage to that of the job's next; the last one is open, so left out."""
    w = Window.partitionBy(job).orderBy(*order)
    changed = events.withColumn("_p", F.lag(stage).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(stage)))
    micros = F.unix_micros(F.lead(F.col(ts).cast("timestamp")).over(w)) - F.unix_micros(F.col(ts).cast("timestamp"))
    return changed.withColumn("micros", micros).where("micros is not null").groupBy(job, stage).agg(F.sum("micros").alias("micros"))


def ratios(durations: DataFrame, job: str, stage: str, amount: str) -> DataFrame:
    """Share of each stage with a positive duration in its job."""
    positive = durations.where(F.col(amount) > 0)
    return positive.withColumn("ratio", F.col(amount) / F.sum(amount).over(Window.partitionBy(job)))


def normalise(weights: DataFrame, bucket: str, weight: str = "weight") -> DataFrame:
    """Weights that add up to one in each bucket; those of a bucket whose sum isn't positive stay."""
    total = F.sum(weight).over(Window.partitionBy(bucket))
    return weights.withColumn(weight, F.when(total > 0, F.col(weight) / total).otherwise(F.col(weight)))


def stage_ranges(weights: DataFrame, bucket: str, order: str, weight: str = "weight") -> DataFrame:
    """start and end percent of each stage, cumulated in order; stages without weight have none."""
    w = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(weight).over(w)
    return weights.where(F.col(weight) > 0).withColumn("end", F.round(upto * 100, 2)).withColumn("start", F.round((upto - F.col(weight)) * 100, 2))


def moving_average(samples: DataFrame, key: str, order: list[str], value: str, start: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(key, n, average): (1 - alpha) * average + alpha * value over each key's samples in order. Without a start the first sample is
    the start; samples of a null key are a key of their own.

    A run of samples maps the average before it to one after it by a factor and an amount. Samples are dealt by range of key and
    order, each range's run of a key is one such pair, from powers of its ranks, and the pairs of a key, one a range, are
    applied in turn. So a key with all samples is spread over all ranges, and no list is longer than their number."""
    dealt = samples.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p", key)
    i = F.row_number().over(w.orderBy(*order))
    share = F.pow(F.lit(1.0 - alpha), F.count(F.lit(1)).over(w) - i) * alpha
    runs = dealt.withColumn("_i", i).withColumn("_w", share).groupBy(key, "_p")
    runs = runs.agg(F.count(F.lit(1)).alias("_m"), F.sum(F.col("_w") * F.col(value)).alias("_s"), F.max(F.when(F.col("_i") == 1, F.col(value).cast("double"))).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_p", "_m", "_s", "_first")))
    begin = F.lit(float(start)) if start is not None else F.col("_r")[0]["_first"]
    fold = F.aggregate("_r", begin, lambda a, r: a * F.pow(F.lit(1.0 - alpha), r["_m"]) + r["_s"])
    return runs.groupBy(key).agg(F.sum("_m").alias("n"), listed.alias("_r")).select(key, "n", fold.alias("average"))


def calibrated(samples: DataFrame, bucket: str, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Which weights a bucket goes by: its history once it has enough samples, else the defaults."""
    n = samples.groupBy(bucket).agg(F.count(F.lit(1)).alias("sample_count"))
    return n.withColumn("weight_source", F.when(F.col("sample_count") >= min_samples, F.lit("historical")).otherwise(F.lit("default")))


CALIBRATION = "map<string, struct<sample_count: long, weights: map<string, double>>>"


def calibration_state(text: Column) -> Column:
    """Calibration by bucket from its JSON text; the defaults where it is missing or can't be read."""
    pairs = lambda w: F.create_map(*[x for s, v in w.items() for x in (F.lit(s), F.lit(v))])
    default = F.create_map(*[x for b, w in DEFAULT_WEIGHTS.items() for x in (F.lit(b), F.struct(F.lit(0).cast("long").alias("sample_count"), pairs(w).alias("weights")))])
    parsed = F.from_json(text, CALIBRATION)
    return F.when(F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{"), parsed).otherwise(default)


def bucket_weights(state: Column, with_publish: bool, min_samples: int = MIN_SAMPLES) -> Column:
    """(weights, weight_source, sample_count) that a bucket goes by: its history once it has enough samples, else the defaults."""
    bucket = "with_publish" if with_publish else "without_publish"
    default = F.create_map(*[x for s, v in DEFAULT_WEIGHTS[bucket].items() for x in (F.lit(s), F.lit(v))])
    n = F.coalesce(state[bucket]["sample_count"], F.lit(0).cast("long"))
    weights = F.when(n >= min_samples, F.coalesce(state[bucket]["weights"], default)).otherwise(default)
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x)
    even = F.when(total > 0, F.transform_values(weights, lambda _, v: v / total)).otherwise(weights)
    return F.struct(even.alias("weights"), F.when(n >= min_samples, F.lit("historical")).otherwise(F.lit("default")).alias("weight_source"), n.alias("sample_count"))


def throttled(events: DataFrame, job: str, seconds: str, percent: str, order: list[str], forced: str | None = None, min_seconds: float = MIN_SECONDS, min_points: float = MIN_POINTS) -> DataFrame:
    """(job, emissions): how many updates of each job get through.

    One is held back if it comes within min_seconds of the last one let through and moves by less than min_points. What counts
    is the last let through, so this is a fold in order: a job's updates stream through one task, sorted, which holds two numbers."""
    schema = T.StructType([events.schema[job], T.StructField("emissions", T.LongType())])
    rows = events.select(job, F.col(seconds).cast("double").alias("_s"), F.col(percent).cast("double").alias("_p"), (F.col(forced) if forced else F.lit(False)).alias("_f"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    rows = rows.repartition(job).sortWithinPartitions(job, *[f"_o{k}" for k in range(len(order))]).select(job, "_s", "_p", "_f")

    def fold(batches):
        current, n, last_s, last_p = None, 0, None, -1.0

        def out(name):
            return pa.RecordBatch.from_arrays([name, pa.array([n], pa.int64())], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            names, s, p, f = b.column(0), *(b.column(k).to_pylist() for k in (1, 2, 3))
            keys = names.to_pylist()
            for k in range(b.num_rows):
                if current is None or keys[k] != current[0]:
                    if current is not None:
                        yield out(current[1])
                    current, n, last_s, last_p = (keys[k], names.slice(k, 1)), 0, None, -1.0
                if f[k] or last_s is None or not (s[k] - last_s < min_seconds and abs(p[k] - last_p) < min_points):
                    n, last_s, last_p = n + 1, s[k], p[k]
        if current is not None:
            yield out(current[1])

    return rows.mapInArrow(fold, schema)
