"""Sources: tables, tile trees, workspaces, fingerprints and JSON documents. All listings go through Spark's own file access."""

from __future__ import annotations

import hashlib
import posixpath
from contextlib import contextmanager
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orospark.functions.labels import DEM_SUFFIXES, RESERVED_FOLDERS, base_name, child_path, suffix


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_inside(spark: SparkSession, path: str, root: str) -> bool:
    """Whether path, with its dots and, on a local file system, its links resolved, is root or lies under it."""

    def resolved(name: str) -> tuple[str, str]:
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
        text = uri.getPath()
        text = spark._jvm.java.io.File(text).getCanonicalPath() if uri.getScheme() == "file" else posixpath.normpath(text)
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}", text.rstrip("/")

    (store, a), (other, b) = resolved(path), resolved(root)
    return store == other and (a == b or a.startswith(b + "/"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a path or pattern names; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


@contextmanager
def open_file(path: str):
    """In a task: a function that reads n bytes at a place of a file, in any store that Arrow knows. The file is never held whole."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif "://" in path:
        store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        name = unquote(name)
    else:
        store, name = fs.LocalFileSystem(), path
    with store.open_input_file(name) as f:
        size = f.size()
        yield lambda at, n: f.read_at(min(n, max(0, size - at)), at) if at < size else b""


def tile_addresses(paths: DataFrame, path: str = "path") -> DataFrame:
    """(z, x, y) of paths that end in z/x/y.terrain with ASCII digits only; others are left out."""
    parts = F.regexp_extract_all(F.col(path), F.lit(r"(?:^|/)([0-9]+)/([0-9]+)/([0-9]+)\.terrain$"), F.lit(0))
    piece = lambda k: F.regexp_extract(path, r"(?:^|/)([0-9]+)/([0-9]+)/([0-9]+)\.terrain$", k)
    return paths.where(F.size(parts) > 0).select(piece(1).cast("int").alias("z"), piece(2).cast("long").alias("x"), piece(3).cast("long").alias("y"))


def scan_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of the tiles under a folder; none if it is missing. Files are listed, not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "z int, x long, y long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.terrain").load(folder).select("path")
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_extract("path", rf"/{_quote(root)}/([0-9]+/[0-9]+/[0-9]+\.terrain)$", 1)
    return tile_addresses(files.select(inside.alias("path")))


def _quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def list_folder(spark: SparkSession, root: str, relative: str = "") -> DataFrame:
    """(name, relative_path, absolute_path, entry_type, selectable) of one folder of a workspace, folders first, by name.

    Elevation files and folders are listed; the reserved folders at the top, and all else, are not. One listing
    call on the driver, as any file system needs; the rest is columns."""
    relative = relative.strip().replace("\\", "/").strip("/")
    where = f"{root.rstrip('/')}/{relative}" if relative else root.rstrip("/")
    if not is_inside(spark, where, root):
        raise ValueError("the path is outside the workspace")
    if not exists(spark, where):
        raise FileNotFoundError(relative or "/")
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        raise ValueError("a file can't be listed")
    rows = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)]
    return entries(spark.createDataFrame(rows, "name string, is_dir boolean"), relative, root)


def entries(names: DataFrame, relative: str = "", root: str = "") -> DataFrame:
    """Workspace entries of a listing (name, is_dir)."""
    rel = child_path(F.lit(relative), F.col("name"))
    top = F.element_at(F.split(rel, "/"), 1)
    kind = F.when(F.col("is_dir"), F.when(~top.isin(*RESERVED_FOLDERS), F.lit("directory"))).when(suffix(F.col("name")).isin(*DEM_SUFFIXES), F.lit("file"))
    out = names.select("name", rel.alias("relative_path"), F.concat(F.lit(root.rstrip("/") + "/"), rel).alias("absolute_path"), kind.alias("entry_type"))
    out = out.where("entry_type is not null").withColumn("selectable", F.col("entry_type") == "file")
    return out.orderBy("entry_type", F.lower("name"), "name")


#: Bytes of a file that a task holds while it hashes it.
PIECE = 8 << 20


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(input_path, file_name, size_bytes, sha256) of the files that a path or pattern names, each hashed piece by piece in a task."""

    def run(batches):
        for b in batches:
            names, sizes, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for name, size in zip(names, sizes, strict=True):
                h = hashlib.sha256()
                with open_file(name) as read:
                    for at in range(0, size, PIECE):
                        h.update(read(at, PIECE))
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["input_path", "size_bytes", "sha256"])

    hashed = listed(spark, path).mapInArrow(run, "input_path string, size_bytes long, sha256 string")
    return hashed.select("input_path", base_name(F.col("input_path")).alias("file_name"), "size_bytes", "sha256")


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole JSON documents; none if there is no such file, for a pattern also if it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
