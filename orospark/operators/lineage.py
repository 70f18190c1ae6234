"""Job documents, manifests and provenance as tables; state is always the fold of an append-only log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.functions.labels import base_name
from orospark.functions.progress import elapsed_seconds, normal_status, restored_progress, stage_of_status

_S = T.StringType()
SOURCE = T.StructType([T.StructField("input_path", _S), T.StructField("file_name", _S), T.StructField("size_bytes", T.LongType()), T.StructField("sha256", _S)])
PUBLISH = T.StructType([T.StructField("published", T.BooleanType()), *(T.StructField(n, _S) for n in ("tileset_name", "terrain_url", "published_at"))])
MANIFEST = T.StructType([T.StructField("schema_version", T.IntegerType()), *(T.StructField(n, _S) for n in ("job_id", "status", "created_at", "updated_at", "completed_at")), T.StructField("source", SOURCE), T.StructField("output_dir", _S), T.StructField("request", _S), T.StructField("publish", PUBLISH), T.StructField("error", _S)])
DETAIL_FIELDS = ("job_id", "status", "progress", "stage", "created_at", "completed_at", "input_path", "output_dir", "terrain_url", "tileset_name", "published", "error")


def read_manifest(text: Column) -> Column:
    """The manifest in a JSON text; null where it isn't an object or can't be read."""
    parsed = F.from_json(text, MANIFEST, {"mode": "PERMISSIVE"})
    return F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), parsed)


def merge_changes(changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Current document of each key: every field has the value of the last change that sets it.

    A change sets the fields that its array ``sets`` names, so an explicit null overwrites and an absent field
    doesn't. Nested fields (source, publish) are merged one level deep by listing them as their own columns."""
    value = lambda f: F.max_by(F.col(f"`{f}`"), F.when(F.array_contains("sets", f), F.col(order)))
    return changes.groupBy(key).agg(*[value(f).alias(f) for f in fields], F.max(order).alias("updated"))


def created(jobs: DataFrame) -> DataFrame:
    """First manifests of jobs (job_id, input_path, output_dir, at, request)."""
    source = F.struct(F.col("input_path"), base_name(F.col("input_path")).alias("file_name"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"))
    none = lambda n: F.lit(None).cast("string").alias(n)
    return jobs.select(
        F.lit(1).alias("schema_version"), "job_id", F.lit("queued").alias("status"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), none("completed_at"), source.alias("source"),
        "output_dir", "request", F.struct(F.lit(False).alias("published"), none("tileset_name"), none("terrain_url"), none("published_at")).alias("publish"), none("error"),
    )


def finished(manifests: DataFrame, ends: DataFrame) -> DataFrame:
    """manifests after the ends (job_id, at, error, terrain_url, tileset_name): failed if an error is given, published if a URL is."""
    m, e = manifests.alias("m"), ends.select("job_id", F.col("at").alias("_at"), F.col("error").alias("_e"), F.col("terrain_url").alias("_u"), F.col("tileset_name").alias("_n"))
    over, failed = F.col("_at").isNotNull(), F.col("_e").isNotNull()
    pub = F.struct(F.lit(True).alias("published"), F.col("_n").alias("tileset_name"), F.col("_u").alias("terrain_url"), F.col("_at").alias("published_at"))
    out = m.join(e, "job_id", "left").withColumn("status", F.when(over, F.when(failed, F.lit("failed")).otherwise(F.lit("completed"))).otherwise(F.col("status")))
    out = out.withColumn("completed_at", F.coalesce("_at", "completed_at")).withColumn("updated_at", F.coalesce("_at", "updated_at"))
    out = out.withColumn("error", F.when(over, F.col("_e")).otherwise(F.col("error")))
    return out.withColumn("publish", F.when(over & ~failed & F.col("_u").isNotNull(), pub).otherwise(F.col("publish"))).drop("_at", "_e", "_u", "_n")


def provenance(published: DataFrame, manifests: DataFrame) -> DataFrame:
    """What each published tileset (job_id, tileset_name, terrain_url, published_at, tiles_dir) was made from; no manifest leaves nulls."""
    m = manifests.select("job_id", "source", "request")
    return published.join(m, "job_id", "left").withColumn("schema_version", F.lit(1))


def job_from_manifest(manifests: DataFrame) -> DataFrame:
    """Job documents from manifests alone."""
    status = normal_status(F.col("status"))
    return manifests.select(
        F.col("job_id"), status.alias("status"), stage_of_status(status).alias("stage"), "created_at", "updated_at", "completed_at", F.col("source.input_path").alias("input_path"), "output_dir",
        F.coalesce(F.col("publish.published"), F.lit(False)).alias("published"), F.col("publish.tileset_name").alias("tileset_name"), F.col("publish.terrain_url").alias("terrain_url"),
        "error", restored_progress(status, F.col("error")).alias("progress"), "request", F.lit(True).alias("from_disk"),
    )


def resolve_jobs(asked: DataFrame, live: DataFrame, manifests: DataFrame, with_tiles: DataFrame) -> DataFrame:
    """Documents of the asked jobs (job_id): the live one, else from the manifest, else completed if tiles are there, else none.

    live has the columns of job_from_manifest but from_disk; with_tiles has job_id and tiles_dir."""
    columns = [c for c in job_from_manifest(manifests).columns if c != "job_id"]
    disk = job_from_manifest(manifests)
    tiles = with_tiles.groupBy("job_id").agg(F.max("tiles_dir").alias("output_dir"))
    done = F.lit("completed")
    made = {"status": done, "stage": F.lit("done"), "published": F.lit(False), "progress": restored_progress(done, F.lit(None).cast("string")), "from_disk": F.lit(True), "output_dir": F.col("output_dir")}
    types = dict(disk.dtypes)
    tiles = tiles.select("job_id", *[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns])
    live = live.withColumn("from_disk", F.lit(False))
    ranked = [d.select("job_id", F.struct(*[F.col(c).cast(types[c]).alias(c) for c in columns]).alias(f"_{k}")) for k, d in enumerate((live, disk, tiles))]
    out = asked.select("job_id").distinct()
    for r in ranked:
        out = out.join(r, "job_id", "left")
    return out.select("job_id", F.coalesce("_0", "_1", "_2").alias("_d")).where("_d is not null").select("job_id", "_d.*")


def job_detail(documents: DataFrame, now: Column) -> DataFrame:
    """Documents (JSON text in ``document``) with the fixed fields as columns, elapsed_seconds, and all others but the request in metadata."""
    fields = F.from_json("document", T.MapType(_S, _S))
    out = documents.withColumn("_m", fields)
    known = {f: F.col("_m")[f] for f in DETAIL_FIELDS}
    rest = F.map_filter("_m", lambda k, _: ~k.isin(*DETAIL_FIELDS, "request"))
    elapsed = elapsed_seconds(known["created_at"], known["completed_at"], known["status"], F.col("_m")["updated_at"], now)
    return out.select(*[c.alias(f) for f, c in known.items()], elapsed.alias("elapsed_seconds"), rest.alias("metadata"))


def unexpired(changes: DataFrame, key: str, ts: str, now: Column, seconds: int = 604_800) -> DataFrame:
    """Changes of keys whose last change is at most so old: every write sets the clock back."""
    last = changes.groupBy(key).agg(F.max(ts).alias("_l"))
    return changes.join(last.where(F.unix_seconds(now) - F.unix_seconds(F.col("_l").cast("timestamp")) <= seconds), key, "left_semi")
