"""Sinks: cells, tiles, descriptors and documents. Spark's committers make each write all or nothing."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orospark.operators.raster import to_blocks


def write_blocks(cells: DataFrame, path: str, size: int = 256, keys: tuple[str, ...] = ()) -> None:
    """Cells in blocks, sorted so that a block's neighbours share a row group."""
    to_blocks(cells, size, keys).sortWithinPartitions(*keys, "block_row", "block_col").write.mode("overwrite").parquet(path)


def write_tiles(tiles: DataFrame, path: str, resume: bool = False) -> None:
    """Tiles by zoom; with resume, those already there stay as they are."""
    if resume:
        from orospark.operators.tiles import missing_tiles
        from orospark.sources.files import exists

        if exists(tiles.sparkSession, path):
            tiles = missing_tiles(tiles, tiles.sparkSession.read.parquet(path).select("z", "x", "y"))
    tiles.withColumn("zoom", F.col("z")).write.partitionBy("zoom").mode("append" if resume else "overwrite").parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder and all in it, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_tile_files(tiles: DataFrame, folder: str) -> int:
    """Bodies of tiles (z, x, y, body) as files z/x/y.terrain under a folder that all executors reach; returns their number.

    A file is written in one go under its own name: a task that runs again writes the same."""

    def run(batches):
        from pyarrow import fs

        local = folder.startswith("file:") or "://" not in folder
        store, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(folder)
        n, made = 0, set()
        for b in batches:
            for z, x, y, body in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("z", "x", "y", "body")), strict=True):
                at = f"{root.rstrip('/')}/{z}/{x}"
                if at not in made:
                    store.create_dir(at)
                    made.add(at)
                with store.open_output_stream(f"{at}/{y}.terrain") as f:
                    f.write(body)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return tiles.select("z", "x", "y", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_text(documents: DataFrame, path: str, text: str) -> None:
    """Small documents, one a line."""
    documents.select(text).coalesce(1).write.mode("overwrite").text(path)


def write_document(spark: SparkSession, path: str, document: dict | str) -> None:
    """One small JSON file, keys sorted, indented by two, in place of what was there: written beside it, then renamed, so that
    a reader sees the old one or the new one."""
    text = json.dumps(json.loads(document) if isinstance(document, str) else document, sort_keys=True, indent=2, ensure_ascii=False)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    target = target.getFileSystem(conf).makeQualified(target)
    out = target.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    context.rename(target.getFileSystem(conf).makeQualified(beside), target, rename)


def append_events(events: DataFrame, path: str) -> None:
    """Rows of a change log, which streams read as they come. Writers don't meet: each writes to a folder of its own, which
    readers skip, and then moves its whole files into the log."""
    spark, own = events.sparkSession, f"{path.rstrip('/')}/_{uuid.uuid4().hex}"
    events.write.parquet(own)
    from_, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (own, path))
    store = to.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(from_):
        if f.getPath().getName().startswith("part-"):
            store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(to, f.getPath().getName()))
    store.delete(from_, True)
