"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to Python code at once; bounds a worker's memory besides its single longest text.
SLICE_BYTES = 8 << 20

#: Rows with texts in an Arrow batch.
BATCH_ROWS = 2500
#: Rows of a batch from Spark's Parquet reader and of one in Arrow where the JVM is to stay small: the vectors of both double
#: as they grow, and large arrays make the heap grow.
READER_ROWS, FEW_ROWS = 256, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, a local one only where it is unset (local mode)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = getattr(spark.sparkContext, "_orospark_dir", None)
    if here is None:
        here = spark.sparkContext._orospark_dir = "file://" + tempfile.mkdtemp(prefix="orospark-")
    return here


#: Paths of tables written within an open scratch(), innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/orospark-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orospark_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once all that was made from them is written too."""
    for t in tables:
        if path := getattr(t, "_orospark_path", None):
            delete(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end all that operators wrote to the shared folder within, results not yet read included.

    Operators discard their own steps; what stays is the table that their result is read from. So write the result
    inside, and nothing else stays."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = BATCH_ROWS, read: int | None = None) -> Iterator[None]:
    """While a step with whole texts is written, hand them to Python in smaller Arrow batches than the default of 10,000
    rows, and with ``read`` have Spark's Parquet reader make batches of so many rows instead of 4096, unless the session has
    its own settings; afterwards the session is as it was.

    A batch is held several times over, in the JVM and in the worker; texts are kilobytes, not numbers."""
    wanted = [("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.parquet.columnarReaderBatchSize", "4096", read)]
    before = {key: spark.conf.get(key, default) for key, default, n in wanted if n}
    try:
        for key, default, n in wanted:
            if before.get(key) == default:
                spark.conf.set(key, str(n))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: A key with over one in so many of the rows counts as hot; there can't be more of them than this.
HOT_KEYS = 50_000
#: and it has at least so many rows.
HOT_ROWS = 20_000


def lookup(rows: DataFrame, found: DataFrame, key: str, hot_keys: int = HOT_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows.join(found, key, "left") for a table ``found`` with one row a key, whatever share of rows one key has.

    Rows of hot keys meet their row of found by a broadcast of at most hot_keys rows, the others by a shuffle. rows is
    read three times: write it before. Null keys find nothing."""
    n = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(hot_rows, n // hot_keys)).select(key)
    if n <= hot_rows or not (keys := [r[0] for r in hot.collect()]):  # at most hot_keys numbers or strings
        return rows.join(found, key, "left")
    few = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([rows.schema[key]])))
    warm = rows.join(few, key, "left_semi").join(F.broadcast(found.join(few, key, "left_semi")), key, "left")
    cold = rows.join(few, key, "left_anti").join(found, key, "left")
    return cold.unionByName(warm)


#: What operators keep in a worker process from task to task, by name.
caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """A dictionary that lives as long as tasks of one operator follow one another in a worker."""
    return caches.setdefault(name, {})


def start_task(keep: str | None = None) -> None:
    """In a worker: forget what other operators kept. A function sent to a worker brings copies of the dictionaries that
    it refers to, so caches go by name."""
    for name, c in caches.items():
        if name != keep:
            c.clear()


def give_memory_back() -> None:
    """In a worker: give memory back to the system; the worker goes on to other slices and tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that would clash with names, in any letter case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES, arrow: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes | None] | pa.LargeBinaryArray]]:
    """Runs of rows of about limit bytes of text, with their texts as UTF-8 (None for null), with arrow as an array."""
    texts = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        run = texts.slice(at, to - at)
        yield batch.slice(at, to - at), run if arrow else run.to_pylist()
        give_memory_back()  # some 10 ms; the allocators would hoard as much as a slice takes
        at = to


def joined(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """All rows in their order, runs of batches as one of at most about limit bytes of text; a larger one stays alone."""
    run, size = [], 0
    for batch in batches:
        n = batch.column(batch.schema.get_field_index(column)).nbytes
        if run and size + n > limit:
            yield pa.concat_batches(run)
            run, size = [], 0
        run.append(batch)
        size += n
    if run:
        yield pa.concat_batches(run)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]], fields: list[T.StructField], text: str = "text", keep_text: bool = True, where: int | None = None, limit: int = SLICE_BYTES, keep: str | None = None, arrow: bool = False) -> DataFrame:
    """Append columns computed from whole texts, by Arrow batches.

    make() runs once in each task and returns the function from texts to columns. Columns of df that clash
    with the new ones go. With ``where``, only rows whose new boolean column of that number is true stay. ``keep`` names
    the operator's own cache(); ``arrow`` gives the function arrays instead of lists, those of short batches
    joined, and short batches go back."""
    kept = without(df, [f.name for f in fields])
    if text not in kept.columns:
        raise ValueError(f"no column {text}, or it clashes with a new one")
    schema = T.StructType([f for f in kept.schema.fields if keep_text or f.name != text] + fields)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task(keep)
        f = make()
        for batch in joined(batches, text, limit) if arrow else batches:
            for rows, texts in slices(batch, text, limit, arrow):
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(texts), types, strict=True)]
                old = [(n, rows.column(i)) for i, n in enumerate(rows.schema.names) if keep_text or n != text]
                out = pa.RecordBatch.from_arrays([c for _, c in old] + new, names=[n for n, _ in old] + [x.name for x in fields])
                out = out if where is None else out.filter(new[where])
                step = FEW_ROWS if arrow else max(1, len(out))
                yield from (out.slice(k, step) for k in range(0, max(1, len(out)), step))
        give_memory_back()

    return kept.mapInArrow(run, schema)


def parts_for(spark: SparkSession, amount: int, each: int) -> int | None:
    """So many partitions that none has more than about ``each`` of an amount; None where the session's number will do, which
    adaptive execution may lower."""
    n = -(-amount // each)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt_by_range(df: DataFrame, order: list, parts: int | None) -> DataFrame:
    """df in ranges of the order, sorted in each."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


#: Rows of a partition in a global sort, about.
RANGE_ROWS = 4_000_000


def global_rank(df: DataFrame, order: list, name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with a gapless rank from 0 in the total order given, without a single-task sort.

    Rows are dealt by range and sorted in their partitions; the rank is the place in the partition plus the
    counts of those before it. Only one count for each partition reaches the driver."""
    spark = df.sparkSession
    dealt = materialise(dealt_by_range(df, order, parts).withColumn("_place", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in dealt.groupBy(F.shiftright("_place", 33).alias("p")).count().collect()}
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((int(p), before))
        before += counts[p]
    offsets = spark.createDataFrame(rows, "_part long, _before long")  # a row for each partition
    joined = dealt.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(offsets), "_part", "left")
    return joined.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_place")
