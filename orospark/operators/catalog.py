"""The catalogue of published tilesets: an append-only log of publish and unpublish events, and views of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orospark.functions.labels import crs_label, format_hint, format_label, job_of_tiles, profile_hint, publish_choice, terrain_url, tileset_name, trim_to_null
from orospark.operators.tiles import DESCRIPTOR, zoom_range

META = ("format", "format_label", "projection", "crs", "min_zoom", "max_zoom")


def layer_metadata(layers: DataFrame, text: str = "layer_json") -> DataFrame:
    """layers with the display metadata of a descriptor; all null where it is missing or can't be read."""
    parsed = F.from_json(text, DESCRIPTOR)
    zooms = zoom_range(F.col("_p.available"))
    out = layers.withColumn("_p", parsed).withColumn("_z", zooms)
    return out.select(*layers.columns, F.col("_p.format").alias("format"), format_label(F.col("_p.format")).alias("format_label"), F.col("_p.projection").alias("projection"), crs_label(F.col("_p.projection")).alias("crs"), F.col("_z.min_zoom").alias("min_zoom"), F.col("_z.max_zoom").alias("max_zoom"))


def publish(requests: DataFrame, base_url: str = "http://localhost:8103", base_path: str = "/tilesets") -> DataFrame:
    """Publish events of requests (job_id or tiles_dir, tileset_name, output_format, profile, layer_json, at).

    Exactly one of job_id and tiles_dir; the job is read off a tiles_dir, else the tileset's name stands for it.
    Requests that can't be published have a reason and no name."""
    both, none = F.col("job_id").isNotNull() & F.col("tiles_dir").isNotNull(), F.col("job_id").isNull() & F.col("tiles_dir").isNull()
    job = F.coalesce("job_id", job_of_tiles(F.col("tiles_dir")), trim_to_null(F.col("tileset_name")))
    out = requests.withColumn("_j", job).withColumn("_n", tileset_name(F.col("_j"), F.col("tileset_name")))
    reason = F.when(both, F.lit("give a job or a folder, not both")).when(none, F.lit("a job or a folder is needed")).when(F.col("_j").isNull(), F.lit("a name is needed")).when(F.col("_n").isNull(), F.lit("the name isn't allowed"))
    meta = layer_metadata(out)
    name = F.when(reason.isNull(), F.col("_n"))
    return meta.select(
        F.col("_j").alias("job_id"), name.alias("name"), reason.alias("reason"), F.coalesce("tiles_dir", F.concat(F.lit("jobs/"), F.col("_j"), F.lit("/tiles"))).alias("tiles_dir"),
        terrain_url(F.lit(base_url), F.lit(base_path), name).alias("terrain_url"), publish_choice(F.col("output_format"), format_hint(F.col("format")), "Mesh").alias("output_format"),
        publish_choice(F.col("profile"), profile_hint(F.col("projection")), "geodetic").alias("profile"), *META, "at", F.lit(True).alias("published"),
    )


def published(events: DataFrame, order: Column | None = None) -> DataFrame:
    """What stands published under each name after all events: the last one wins, an unpublish takes it away."""
    order = F.col("at") if order is None else order
    fields = [c for c in events.columns if c != "name"]
    last = events.where("name is not null").groupBy("name").agg(F.max_by(F.struct(*fields), order).alias("_e")).select("name", "_e.*")
    return last.where("published")


def listing(tilesets: DataFrame) -> DataFrame:
    """By name, whatever its case; hidden names aren't listed."""
    return tilesets.where(~F.col("name").startswith(".")).orderBy(F.lower("name"), "name")


def display_metadata(names: DataFrame, cached: DataFrame, sidecars: DataFrame, layers: DataFrame) -> DataFrame:
    """Metadata of each name: from the cache, else its sidecar, else its descriptor; all but names are keyed by name."""
    out = names
    for k, d in enumerate((cached, sidecars, layers)):
        out = out.join(d.select("name", F.struct(*META).alias(f"_{k}")), "name", "left")
    return out.select(*names.columns, F.coalesce("_0", "_1", "_2").alias("_m")).select(*names.columns, "_m.*")


def publishable(jobs: DataFrame) -> DataFrame:
    """Jobs that are over (or being published) and have an output."""
    return jobs.where(F.col("status").isin("completed", "publishing") & F.col("output_dir").isNotNull())
