"""SimHash near-duplicates: fingerprints within a Hamming distance are linked through the anchor points of a covering code."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import HOT_KEYS, HOT_ROWS, discard, lookup, map_texts, materialise, smaller_batches, table
from orospark.llm.components import connected_components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Homes and rows of an anchor in one part of it; an anchor with more is split in a grid of such parts.
ANCHOR_HOMES, ANCHOR_ROWS = 4096, 1 << 17
#: Rows to drop that are told to all executors at most, by 16 bytes each; beyond it they meet their texts by a shuffle.
BROADCAST_ROWS = 500_000
#: Replicated rows in a partition, about.
PARTITION_ROWS = 400_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text; 0 for one without words."""
    from xxhash import xxh64_intdigest

    w = (text or b"").translate(_ASCII_LOWER).split()
    if not w:
        return 0
    runs = map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) > shingle else [b" ".join(w)]
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter(map(xxh64_intdigest, runs, repeat(seed)), np.uint64, n).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def add_fingerprints(docs: DataFrame, text: str = "text", keep_text: bool = True, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([simhash(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, make, [T.StructField(name, T.LongType())], text, keep_text)


#: A half of a fingerprint is a word of the [31, 26] Hamming code (radius 1, perfect) and one free bit.
_H = np.arange(1, 32, dtype=np.uint32)  # column i of the parity check is i + 1
_WORD = np.uint32(0x7FFFFFFF)


def _syndromes(x: np.ndarray) -> np.ndarray:
    s = np.zeros(x.shape, np.uint32)
    for bit in range(5):
        mask = np.uint32(sum(1 << i for i in range(31) if (i + 1) >> bit & 1))
        s |= (np.bitwise_count(x & mask).astype(np.uint32) & 1) << np.uint32(bit)
    return s


def home_anchor(x: np.ndarray) -> np.ndarray:
    """The code word within the covering radius of each 32-bit half; the free bit is kept."""
    s = _syndromes(x)
    flip = np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), 0).astype(np.uint32)
    return x ^ flip


def _pairs_to(s: int) -> np.ndarray:
    """Masks of weight 2 whose syndrome is s."""
    return np.array(sorted({(1 << (int(a) - 1)) | (1 << ((int(a) ^ s) - 1)) for a in _H if int(a) ^ s and int(a) != int(a) ^ s}), np.uint32)


_PAIRS = [np.zeros(15, np.uint32)] + [_pairs_to(s) for s in range(1, 32)]


def replica_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all anchors within covering radius plus one of each half, but for its home.

    Two fingerprints at distance 3 or less differ in at most one bit of one of their halves. There the home of one, at
    most the radius from it, is at most radius plus one from the other. So with halves radius plus *one* finds every
    link, where whole fingerprints would need radius plus threshold."""
    s, home = _syndromes(x), home_anchor(x)
    free = np.uint32(1) << np.uint32(31)
    rows, anchors = [np.arange(len(x))], [home ^ free]  # the free bit differs
    off = np.flatnonzero(s > 0)  # a code word has no other within 2
    table = np.stack(_PAIRS)
    rows.append(np.repeat(off, 15))
    anchors.append((x[off][:, None] ^ table[s[off]]).ravel())
    return np.concatenate(rows), np.concatenate(anchors)


def _replicate(fp: DataFrame) -> DataFrame:
    """(anchor, fp, home): anchor holds the half's number and the code word."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                fps = b.slice(at, 20_000).column(0).to_numpy()
                for half in range(2):
                    x = ((fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    rows, far = replica_anchors(x)
                    anchors = np.concatenate([home_anchor(x), far]).astype(np.int64) | (half << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.concatenate([fps, fps[rows]])), pa.array(np.arange(len(anchors)) < len(x))], names=["anchor", "fp", "home"])

    return fp.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, instead of all links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


_HOME, _ROW = 1, 2


def _links(anchor: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, as a spanning forest: each home meets all rows of its anchor. Work is cut into blocks of about most comparisons."""
    of = lambda bit: (k := np.flatnonzero(side & bit))[np.argsort(anchor[k], kind="stable")]
    homes, rows = of(_HOME), of(_ROW)
    at = anchor[rows]
    start = np.searchsorted(at, anchor[homes], "left")
    n = np.searchsorted(at, anchor[homes], "right") - start
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, ends = 0, np.cumsum(n)
    while done < len(homes):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
        k = n[done:to]
        x = fp[np.repeat(homes[done:to], k)]
        y = fp[rows[np.repeat(start[done:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]]
        near = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= distance) & (x != y)
        u, v = _forest(np.concatenate([u, x[near]]), np.concatenate([v, y[near]]))
        done = to
    return u, v


def fingerprint_components(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, label) of the linked fingerprints; the replicas are gone afterwards."""
    links, steps = fingerprint_links(fps, distance, keep=False)
    out = connected_components(links)
    discard(*steps)
    return out


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, anchor_homes: int = ANCHOR_HOMES, anchor_rows: int = ANCHOR_ROWS, keep: bool = True):
    """Links (u, v) that connect all distinct fingerprints within the distance (3 at most), without pairs for all links.

    An anchor with more homes or rows than one part may hold is split in a grid: its homes in p lots, its rows in q, and
    each of the p q parts gets one lot of either, so neither a part's rows nor its comparisons grow with the anchor."""
    if distance > DISTANCE:
        raise ValueError("the halves' radius covers distances up to 3")
    spark = fps.sparkSession
    rows = materialise(_replicate(fps))
    total = rows.count()
    sizes = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("homes"))
    lots = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    hot = materialise(sizes.where((F.col("homes") > anchor_homes) | (F.col("rows") > anchor_rows)).where("homes > 0").select("anchor", lots("homes", anchor_homes).alias("p"), lots("rows", anchor_rows).alias("q")))
    side = lambda bit: F.lit(bit).cast("byte")
    whole = F.when(F.col("home"), side(_HOME | _ROW)).otherwise(side(_ROW))
    if hot.isEmpty():
        dealt = rows.select("anchor", "fp", whole.alias("side"), F.lit(0).alias("part"))
    else:
        met = lookup(rows, hot, "anchor")
        lot = lambda seed, n: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
        spot = lambda i, bit: F.struct(i.cast("int").alias("part"), side(bit).alias("side"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_row = F.transform(upto("p"), lambda i: spot(i * F.col("q") + lot(1, "q"), _ROW))
        as_home = F.when(F.col("home"), F.transform(upto("q"), lambda j: spot(lot(2, "p") * F.col("q") + j, _HOME))).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("side", T.ByteType())]))))
        cold = met.where("p is null").select("anchor", "fp", whole.alias("side"), F.lit(0).alias("part"))
        split = met.where("p is not null").select("anchor", "fp", F.explode(F.concat(as_row, as_home)).alias("s")).select("anchor", "fp", "s.side", "s.part")
        dealt = cold.unionByName(split)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_ROWS))

    def run(batches):
        held = [[], [], []]
        for b in batches:
            get = lambda k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            held[0].append(get("anchor") ^ (get("part").astype(np.int64) << 33))
            held[1].append(get("fp"))
            held[2].append(get("side"))
        if held[0]:
            u, v = _links(*map(np.concatenate, held), distance)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    links = dealt.repartition(n, "anchor", "part").mapInArrow(run, "u long, v long")
    return links if keep else (links, [rows, hot])


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """key, fp (signed long) and component_id, the least key reachable over links; a row for each row of docs.

    A null or empty text has fingerprint 0, linked like any other. Equal fingerprints are one class from the
    start, so copies are never paired. Rows with a null key take part; they are nobody's component_id unless
    no other key is there. Very long texts are read whole, repeated rows each get their row, an empty table stays
    empty, and other columns of docs go, so none can clash."""
    with smaller_batches(docs.sparkSession):
        prints = materialise(add_fingerprints(docs.select(key, text), text, keep_text=False))
    classes = materialise(prints.groupBy("fp").agg(F.min(key).alias("_least")))
    component = materialise(_components(classes, distance).select("fp", F.col("_first._least").alias("component_id")))
    discard(classes)
    return lookup(prints, component, "fp").select(key, "fp", "component_id")


def _components(classes: DataFrame, distance: int) -> DataFrame:
    """(fp, label, _first) of classes (fp, and further columns): _first is the least of its component, by (whether _least is null, _least, fp)."""
    labels = fingerprint_components(classes, distance)
    known = materialise(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    rest = [c for c in classes.columns if c not in ("fp", "_least")]
    first = known.groupBy("label").agg(F.min(F.struct(F.col("_least").isNull().alias("_none"), "_least", "fp", *rest)).alias("_first"))
    out = materialise(lookup(known, first, "label").select("fp", "label", "_first"))
    discard(labels, known)
    return out


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near-duplicates, the columns as they were.

    It is a row of the least key (null only if all are), of those the one with the least fingerprint and the least hash.
    Rows are told apart by two 64-bit hashes of key and text, never by the key alone: rows of one key with unrelated texts
    lie in different groups, and each group keeps its row. Of rows equal in key and text one stays, any if other columns
    differ. Null and empty texts are one group, very long texts are read whole, an empty table stays empty; no column
    name clashes but _orospark_a and _orospark_b.

    Texts aren't shuffled, but for those of rows repeated as a whole: the rows to drop are told to all executors if they are
    at most BROADCAST_ROWS. Beyond it, all rows meet the list of those that stay by a shuffle on the hashes."""
    a, b = "_orospark_a", "_orospark_b"
    marked = docs.withColumn(a, F.xxhash64(key, text)).withColumn(b, F.xxhash64(F.lit(1), text, key))
    with smaller_batches(docs.sparkSession):
        prints = materialise(add_fingerprints(marked.select(F.col(key).alias("_key"), text, a, b), text, keep_text=False))
    least = F.min(F.struct(F.col("_key").isNull().alias("_none"), F.col("_key"), F.col(a), F.col(b)))
    classes = materialise(prints.groupBy("fp").agg(least.alias("_l")).select("fp", F.col("_l._key").alias("_least"), f"_l.{a}", f"_l.{b}"))
    component = _components(classes, DISTANCE)
    stays = component.groupBy("label").agg(F.first("_first").alias("_first")).select(f"_first.{a}", f"_first.{b}")
    stays = materialise(stays)
    total = prints.count()
    counts = prints.groupBy(a, b).agg(F.count(F.lit(1)).alias("_rows"))
    rows = materialise(counts.join(stays.withColumn("_stays", F.lit(True)), [a, b], "left"))
    discard(prints, classes, component, stays)
    once = rows.where("_stays and _rows = 1").select(a, b)
    repeated, go = rows.where("_stays and _rows > 1").select(a, b), rows.where("_stays is null or _rows > 1").select(a, b)
    if go.count() <= BROADCAST_ROWS:
        one_each = marked.join(F.broadcast(repeated), [a, b], "left_semi").dropDuplicates([a, b])
        kept = marked.join(F.broadcast(go), [a, b], "left_anti").unionByName(one_each)
    else:
        hot = rows.where(F.col("_rows") > max(HOT_ROWS, total // HOT_KEYS))  # at most HOT_KEYS: a row repeated so often isn't shuffled
        cold = marked.join(F.broadcast(hot.select(a, b)), [a, b], "left_anti")
        kept = cold.join(once, [a, b], "left_semi").unionByName(cold.join(repeated, [a, b], "left_semi").dropDuplicates([a, b]))
        kept = kept.unionByName(marked.join(F.broadcast(hot.where("_stays").select(a, b)), [a, b], "left_semi").dropDuplicates([a, b]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; odd rows as in near_duplicates()."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
