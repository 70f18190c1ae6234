"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import cache, discard, map_texts, materialise

WINDOW = 13
#: Benchmark text of one matcher, about; a matcher takes some 50 times that in a worker's memory.
BLOCK_BYTES = 4 << 20
#: Contaminated: hit words make up one in so many or more.
ONE_IN = 20

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_SPACED).split()


class WuManber:
    """Finds all occurrences of patterns of at least one word; blocks are pairs of words (one where a pattern has only one).

    The shift table says how far a window may move on when its last block is seen; at shift 0 the bucket of
    the suffix block and the first word holds the patterns to compare directly. Patterns are word numbers, packed."""

    def __init__(self, patterns: list[bytes], size: int):
        self.m = min(map(len, patterns)) // 4
        self.block = min(2, self.m)
        self.size = size
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[bytes] | bytes] = {}
        for p in patterns:
            ids = array("I", p)
            for end in range(self.block - 1, self.m):
                code = self._code(ids, end)
                if self.shift.get(code, self.m) > self.m - 1 - end:
                    self.shift[code] = self.m - 1 - end
            key = self._code(ids, self.m - 1) * size + ids[0]
            there = self.buckets.get(key)
            self.buckets[key] = p if there is None else [there, p] if isinstance(there, bytes) else [*there, p]

    def _code(self, ids, end: int) -> int:
        return ids[end] if self.block == 1 else ids[end - 1] * self.size + ids[end]

    def search(self, ids: list[int], packed: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of each occurrence, in order of start. Id 0 stands for words that no pattern has."""
        m, n, size, pair = self.m, len(ids), self.size, self.block == 2
        get, most, found = self.shift.get, self.m - self.block + 1, []
        end = m - 1
        while end < n:
            last = ids[end]
            if not last:
                end += m
                continue
            code = ids[end - 1] * size + last if pair else last
            move = get(code, most)
            if not move:
                start = end - m + 1
                there = self.buckets.get(code * size + ids[start], ())
                for p in (there,) if isinstance(there, bytes) else there:
                    if packed.startswith(p, 4 * start):
                        found.append((start, p))
                move = 1
            end += move
        return found


class Matcher:
    """Windows of a set of items, with the items that each belongs to. An item without a name has windows, too."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = list(dict.fromkeys(i for i, _ in items))
        number = {i: k for k, i in enumerate(self.names)}
        owners: dict[bytes, int | set[int]] = {}
        for item, text in items:
            w = array("I", [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]).tobytes()
            own = number[item]
            for at in range(0, max(4, len(w) - 4 * window + 4) if w else 0, 4):
                p = w[at : at + 4 * window]
                there = owners.setdefault(p, own)
                if not isinstance(there, int):
                    there.add(own)
                elif there != own:
                    owners[p] = {there, own}
        self.owners = owners
        # shorter patterns would shorten all shifts: they have matchers of their own
        lengths = defaultdict(list)
        for p in owners:
            lengths[window if len(p) == 4 * window else min(len(p) // 4, 4)].append(p)
        self.search = [WuManber(x, len(self.ids) + 1) for x in lengths.values()]

    def __call__(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        get = self.ids.get
        ids = [get(w, 0) for w in found]
        packed = array("I", ids).tobytes() if any(ids) else b""
        spans, items = [], set()
        for s in self.search if packed else ():
            for start, p in s.search(ids, packed):
                spans.append((start, start + len(p) // 4))
                own = self.owners[p]
                items.update((own,) if isinstance(own, int) else own)
        return spans, {self.names[k] for k in items}


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in the union of the spans."""
    total, to = 0, 0
    for a, b in sorted(spans):
        if b > to:
            total += b - max(a, to)
            to = b
    return total


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(i, t, b): distinct items with their block, of about block_bytes of text each or one item, and the number of blocks."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))), n


_LONG = T.LongType()
_FIELDS = [T.StructField("n_words", _LONG), T.StructField("n_hit", _LONG), T.StructField("n_items", _LONG), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("_clean", T.BooleanType())]
_SPANS, _ITEMS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def _columns(n: list[int], spans: list[list[tuple[int, int]]], items: list[set[str | None]], one_in: int) -> list:
    hit = [covered(s) for s in spans]
    bad = [h > 0 and one_in * h >= k for h, k in zip(hit, n, strict=True)]
    digest = [hashlib.sha256(",".join(sorted(x for x in i if x is not None)).encode()).hexdigest() for i in items]
    return [n, hit, [len(i) for i in items], digest, bad, [not x for x in bad]]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, one_in: int = ONE_IN, keep_text: bool = True, only_clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A null or empty text has no words and is clean; repeated rows each get their own result; very long texts are read
    whole; an empty benchmark hits nothing; items without an id hit like others, count as one item and aren't in the
    digest; columns of docs that clash with the new ones go. With only_clean, contaminated documents go.

    A benchmark of one block is sent to all executors, and the texts are walked once. A larger one is searched for block
    after block: the driver holds one at a time, each worker builds its matcher once and forgets it, and only what was
    hit is written in between; docs are written once with a number for each row, to bring the hits together."""
    blocks, n = benchmark_blocks(benchmark, item=item, block_bytes=block_bytes)
    where = 5 if only_clean else None
    if n == 1:
        block = _share(blocks, 0)

        def make():
            def f(texts):
                match, found = _matcher(block, window), [words(t) for t in texts]
                got = [match(w) for w in found]
                return _columns([len(w) for w in found], [s for s, _ in got], [i for _, i in got], one_in)

            return f

        return map_texts(docs, make, _FIELDS, text, keep_text, where=where, keep=MATCHERS).drop("_clean")

    rows, blocks = materialise(docs.withColumn("_orospark_row", F.monotonically_increasing_id())), materialise(blocks)
    hits = [_hits(rows.select("_orospark_row", text), _share(blocks, k), text, window) for k in range(n)]
    every = reduce(DataFrame.unionByName, hits).groupBy("_orospark_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))
    hit = materialise(every)  # a row for each document with a hit
    joined = rows.join(hit, "_orospark_row", "left").drop("_orospark_row")
    discard(blocks, *hits)
    return _finish(joined, text, one_in, keep_text, where)


def _share(blocks: DataFrame, k: int) -> tuple:
    """Items of one block, bounded by its bytes, for all executors."""
    return uuid.uuid4().hex, blocks.sparkSession.sparkContext.broadcast([(r.i, r.t.encode()) for r in blocks.where(F.col("b") == k).collect()])


def _hits(rows: DataFrame, block: tuple, text: str, window: int) -> DataFrame:
    """(_orospark_row, _spans, _items) of the rows that a block hits: starts and ends, and names, one null for all without."""

    def make():
        def f(texts):
            match = _matcher(block, window)
            got = [match(words(t)) for t in texts]
            return [[[x for ab in s for x in ab] for s, _ in got], [list(i) for _, i in got], [bool(s) for s, _ in got]]

        return f

    out = map_texts(rows, make, [T.StructField("_spans", _SPANS), T.StructField("_items", _ITEMS), T.StructField("_any", T.BooleanType())], text, False, where=2, keep=MATCHERS)
    written = materialise(out.drop("_any"))
    block[1].destroy()
    return written


def _finish(joined: DataFrame, text: str, one_in: int, keep_text: bool, where: int | None) -> DataFrame:
    """The columns of find_contamination() from spans and items of all blocks, which go."""
    import pyarrow as pa

    from orospark.llm.common import slices, without

    kept = without(joined, [f.name for f in _FIELDS])
    fields = [f for f in kept.schema.fields if f.name not in ("_spans", "_items") and (keep_text or f.name != text)]
    schema = T.StructType(fields + _FIELDS)

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, text):
                get = lambda name: rows.column(rows.schema.get_field_index(name))  # noqa: B023, E731
                spans = [list(zip(s[::2], s[1::2], strict=True)) if s else [] for s in get("_spans").to_pylist()]
                new = _columns([len(words(t)) for t in texts], spans, [set(i or ()) for i in get("_items").to_pylist()], one_in)
                columns = [pa.array(x, y) for x, y in zip(new, (*[pa.int64()] * 3, pa.string(), pa.bool_(), pa.bool_()), strict=True)]
                out = pa.RecordBatch.from_arrays([*(get(f.name) for f in fields), *columns], names=schema.names)
                yield out if where is None else out.filter(columns[where])

    return kept.mapInArrow(run, schema).drop("_clean")


#: Name of the matchers' cache().
MATCHERS = "matchers"
_built: dict[tuple[str, int], Matcher] = cache(MATCHERS)


def _matcher(block: tuple, window: int) -> Matcher:
    """A worker builds the matcher of a block once, and keeps that of one block."""
    key = (block[0], window)
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(block[1].value, window)
    return _built[key]


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in each document; odd rows as in find_contamination()."""
    from orospark.llm.common import table

    return find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
iw as (select distinct item_id, least({WINDOW}, len(w)) as k, array_to_string(w[s : s + {WINDOW - 1}], ' ') as win from b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) u(s) where len(w) > 0),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as win from d, (select distinct k from iw) q, unnest(range(1, len(w) - k + 2)) u(i)),
hit as (select doc_id, i, dw.k, item_id from dw join iw on dw.k = iw.k and dw.win = iw.win),
n_hit as (select doc_id, count(distinct i + j) as n from hit, unnest(range(k)) u(j) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(w) as n_words, coalesce(h.n, 0) as n_hit, coalesce(i.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 and {ONE_IN} * coalesce(h.n, 0) >= len(w) as contaminated
from d left join n_hit h using (doc_id) left join items i using (doc_id)
"""
