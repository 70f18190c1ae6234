"""Operators with exact contracts, against plain single-machine versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm import decontaminate, packing, sharding, simhash, token_files
from orospark.llm.common import FEW_ROWS, READER_ROWS, joined, lookup, map_texts, scratch
from orospark.llm.components import connected_components
from orospark.llm.tokens import ENCODERS, ChunkEncoder, encoder, tokenizer_path

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "word " * 30000), (None, "null key"), (7, "a  b\x1cc é日本語 <|endoftext|>")]


def odd(spark, extra=()):
    return spark.createDataFrame([*ODD, *extra], "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("N_Words", F.lit(1))


def docs(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_contamination(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i if i is None else str(i))
    sizes = {len(p) for p in windows}
    out = []
    for t in texts:
        w = WORD.findall(low(t))
        hit, got = set(), set()
        for k in range(len(w)):
            for n in sizes:
                if (p := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + len(p)))
                    got |= windows[p]
        out.append((len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got - {None})).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination_matches_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op9_decontaminate(spark, SF).collect()}
    want = docs(spark)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == dict(zip(want, brute_contamination(want.values(), items), strict=True))
    assert any(v[4] for v in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_contamination_small_words(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab cd É x1".split()) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 5, 8, 13, 14, 30]) if k else 0)) for k in range(12)] + [(99, None), (None, "ab"), (None, "cd ab ab")]
    texts = [text(rng.randint(0, 80)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        n = decontaminate.benchmark_blocks(bench, block_bytes=block)[1]
        assert n == 1 or n >= 3
        for clean in (False, True):
            got = decontaminate.find_contamination(rows, bench, block_bytes=block, only_clean=clean).orderBy("doc_id").collect()
            assert [tuple(r)[2:] for r in got] == [x for x in brute_contamination(texts, items) if not (clean and x[4])]


def test_a_worker_builds_each_block_once(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"w{k} " * 20) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"w{k % 50} " * 30) for k in range(400)], "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.find_contamination(docs, bench).collect()))
    assert decontaminate.benchmark_blocks(bench, block_bytes=250)[1] >= 10
    assert sorted(map(tuple, decontaminate.find_contamination(docs, bench, block_bytes=250).collect())) == one
    made, block = [], ("x", type("B", (), {"value": [("a", b"one two")]}))
    monkeypatch.setattr(decontaminate, "Matcher", lambda items, window: made.append(items) or "matcher")
    assert [decontaminate._matcher(block, 13) for _ in range(5)] == ["matcher"] * 5 and len(made) == 1


def test_contamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    got = decontaminate.find_contamination(odd(spark), bench, keep_text=False)
    assert got.columns == ["doc_id", "shard", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(r.doc_id for r in got.where("contaminated").collect()) == {4: 2}
    none = decontaminate.find_contamination(odd(spark), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(odd(spark).limit(0), bench).count() == 0
    many = decontaminate.find_contamination(odd(spark), bench.union(spark.createDataFrame([(2, "x y z")], bench.schema)), keep_text=False, block_bytes=2)
    assert many.columns == got.columns and sorted(map(str, many.collect())) == sorted(map(str, got.collect()))


# tokens


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    def load(name):
        t = Tokenizer.from_file(tokenizer_path(name))
        return lambda text: t.encode(text, add_special_tokens=False).ids

    return load


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name, whole):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t\0abAé'!1  s\x1cß́ćΣ") for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    texts += ["it's  I'm\tok you've", "<|endoftext|> x <|startoftext|>", "日本 語 　x", "x" * 5000, "\x00a\x1f c", "a\x01 b"]
    e, one = ChunkEncoder(tokenizer_path(name)), whole(name)
    for _ in range(2):  # the second time from the cache
        ids, ends = e.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [one(t) for t in texts]
    assert e.encode([])[1].tolist() == [0] and e.encode([None, b""])[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_library(name):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(tokenizer_path(name)), random.Random(6)
    texts = ["end of page <|endoftext|> next page", "a<|endoftext|>b", "<|endoftext|>", " <|startoftext|>\n\nx", "<|ENDOFTEXT|> <|endoftext", "no such string"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", " ", "\n", "ab", "It's", ".", "1"]) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    e = encoder(tokenizer_path(name))
    for _ in range(2):  # the second time from the cache
        ids, ends = e.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_library_gets_each_new_chunk_once(whole):
    """Each id costs the library's time: none for separators, none twice, none for what is known."""
    e, one, made = ChunkEncoder(tokenizer_path("byte_bpe_50k.json")), whole("byte_bpe_50k.json"), []
    plain = e.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            out = plain.encode_batch_fast(texts, **options)
            made.extend(len(x.ids) for x in out)
            return out

    e.tokenizer = Counted()
    words = [f"foranouha{chr(97 + k % 26)}{chr(97 + k // 26)}lich" for k in range(600)]
    texts = ["x " + " ".join(words[k : k + 100]) for k in range(0, len(words), 100)] * 3
    for _ in range(2):
        ids, ends = e.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [one(t) for t in texts]
    once = sum(len(one(" " + w)) for w in words) + 2  # and a line feed and "x", first of all
    assert sum(made) <= once
    texts = [t.replace("lich", m) for t in texts[:6] for m in ("lich,", "lich!?")]
    ids, ends = e.encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [one(t) for t in texts]
    assert sum(made) <= once + 8  # two kinds of marks more


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_characters_in_arrays(name, whole):
    rng, e, one = random.Random(7), ChunkEncoder(tokenizer_path(name)), whole(name)
    parts = [*"\n\r\t\x0b\x85\xa0\u180e\u2009\u3000\u200b\ufeffaé'!1,٣²日😀_\x01ĠĊ", *[" "] * 12, "'ll", "word", "Wort,", "[UNK]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(4000)]
    ids, ends = e.encode(pa.array([None, b"a \xff b", *[t.encode() for t in texts]], pa.large_binary()).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [one(t) for t in ["a \ufffd b", *texts]]


def test_workers_keep_their_own_cache_only(spark):
    def kept_in(keep):
        def make():
            from orospark.llm.tokens import encoders

            known = "x" in encoders
            encoders["x"] = None
            return lambda texts: [[known] * len(texts)]

        rows = spark.range(0, 64, 1, 64).select(F.lit("t").alias("text"))
        return map_texts(rows, make, [T.StructField("known", T.BooleanType())], keep=keep).where("known").count()

    assert kept_in(ENCODERS) >= 32 and kept_in("another") == 0


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, whole, tmp_path):
    want, one, start = docs(spark), whole("byte_bpe_50k.json"), 0
    got = {r.doc_id: tuple(r)[1:] for r in token_files.op5_token_files(spark, SF).collect()}
    assert len(got) == len(want)
    for k in sorted(want):
        ids = [*one(want[k]), 0]
        assert got[k] == (start, len(ids), crc(ids))
        start += len(ids)
    out = f"file://{tmp_path}/t"
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), out, tokenizer_path("byte_bpe_50k.json"))
    assert {r.doc_id: r.ids for r in token_files.read_tokens(spark, out, [3, 700]).collect()} == {k: [*one(want[k]), 0] for k in (3, 700)}
    import pyarrow.parquet as pq

    f = pq.ParquetFile(next(tmp_path.glob("t/part*")))
    col = f.metadata.row_group(0).column(f.schema.names.index("doc_id") if "doc_id" in f.schema.names else 0)
    assert col.has_offset_index and col.has_column_index and "DELTA_BINARY_PACKED" in col.encodings


def test_token_files_odd_rows(spark, whole, tmp_path):
    out = f"file://{tmp_path}/t"
    token_files.write_token_files(odd(spark), out, tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(((r.start, r.n_tokens) for r in token_files.read_index(spark, out).collect()))
    assert len(rows) == len(ODD) and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))
    one = whole("byte_bpe_50k.json")
    want = Counter((k, len(one(t or "")) + 1, crc([*one(t or ""), 0])) for k, t in ODD)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.id_checksums(spark, out).collect()) == want
    assert [r.doc_id for r in token_files.read_index(spark, out).orderBy("start").collect()] == sorted((k for k, _ in ODD), key=lambda k: -1 if k is None else k)
    empty = f"file://{tmp_path}/e"
    token_files.write_token_files(odd(spark).limit(0), empty, tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_index(spark, empty).count() == 0


def test_token_files_pass_the_jvm_in_small_batches(spark, whole, monkeypatch):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    settings, seen = (lambda: [spark.conf.get(k) for k in keys]), []
    before = settings()
    for name in ("encode_documents", "id_checksums"):
        monkeypatch.setattr(token_files, name, lambda *a, f=getattr(token_files, name), **b: seen.append(settings()) or f(*a, **b))
    got = token_files.op5_token_files(spark, "/root/testdata/sf0.001")
    want, one = docs(spark, "/root/testdata/sf0.001"), whole("byte_bpe_50k.json")
    assert {r.doc_id: r.ids_crc32 for r in got.collect()} == {k: crc([*one(t), 0]) for k, t in want.items()}
    assert settings() == before == ["10000", "4096"] and seen == [[str(FEW_ROWS), str(READER_ROWS)]] * 2
    assert "ids:array" not in got._jdf.queryExecution().executedPlan().toString()  # the files are read by then


def test_joined_batches():
    texts = [["a" * 40] * 3, [], [None, "b" * 40], ["c" * 900], ["d"], ["e"] * 400, [""]]
    batches, at = [], 0
    for t in texts:
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(at, at + len(t)), pa.int64()), pa.array(t, pa.string())], names=["k", "t"]))
        at += len(t)
    got = list(joined(iter(batches), "t", 300))
    assert [x for b in got for x in b.to_pylist()] == [x for b in batches for x in b.to_pylist()]
    assert [len(b) for b in got] == [5, 1, 1, 400, 1] and not list(joined(iter([]), "t", 300))
    cut = [b.slice(k, 1) for b in batches for k in range(len(b))]  # slices count for themselves
    assert [len(b) for b in joined(iter(cut), "t", 300)][:2] == [5, 1]


def naive_best_fit(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in left if c >= n]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - n)
        else:
            left.append(window - n)
    return left


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 50, 64])
    lengths = [rng.randint(1, window) if rng.random() < 0.7 else rng.choice([1, 2, window // 2, window]) for _ in range(rng.choice([0, 1, 30, 300]))]
    plan, bins = packing.best_fit_decreasing(Counter(lengths), window)
    falling, fills = sorted(lengths, reverse=True), defaultdict(list)
    for rank, n in enumerate(falling):
        first, seq, at = plan[np.searchsorted(plan[:, 0], rank, "right") - 1]
        fills[seq + rank - first].append((at, n))
    want = naive_best_fit(lengths, window)
    assert set(fills) == set(range(bins)) and bins == len(want)
    for f in fills.values():
        to = 0
        for at, n in sorted(f):
            assert at == to
            to += n
    assert sorted(window - sum(n for _, n in f) for f in fills.values()) == sorted(want)


def test_packing_places_each_id_once(spark, whole):
    want, one = docs(spark), whole("word_bpe_49k.json")
    rows = packing.op8_packing(spark, SF).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, t in want.items():
        ids, to = [*one(t), 2], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == to and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[to : to + r.length])
            to += r.length
        assert to == len(ids)
    for s in by_seq.values():
        to = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == to
            to += r.length
        assert to <= 4096
    total = sum(r.length for r in rows)
    assert sorted(by_seq) == list(range(len(by_seq))) and len(by_seq) <= -(-total // 4096) + 1


def test_packed_sequences_and_odd_rows(spark, whole):
    one = whole("word_bpe_49k.json")
    twice = [(4, "two texts under one key"), (None, "another null key"), (None, "null key")]
    pieces = packing.cut_documents(odd(spark, [(*r,) for r in twice]), tokenizer_path("word_bpe_49k.json"), with_ids=True)
    placed = packing.pack(pieces)
    seqs = packing.sequences(placed, pad_id=9).collect()
    assert all(len(r.ids) == 4096 or (r.n_tokens & (r.n_tokens - 1) == 0 and len(r.ids) == r.n_tokens) for r in seqs)
    assert sum(r.n_tokens for r in seqs) == pieces.agg(F.sum("length")).first()[0]
    by = {r.sequence_id: r.ids for r in seqs}
    got = Counter()
    for r in placed.where("length = doc_tokens").collect():
        assert by[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        got[r.doc_id, tuple(r.ids)] += 1
    assert got == Counter((k, tuple([*one(t or ""), 2])) for k, t in [*ODD, *twice] if len(t or "") < 100)
    assert packing.pack_documents(odd(spark), tokenizer_path("word_bpe_49k.json")).where("start = 0").count() == len(ODD)
    assert packing.pack_documents(odd(spark).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


# sharding


def test_hilbert_curve_is_continuous():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        order = np.argsort(h := sharding.hilbert_index(grid, bits))
        assert sorted(h) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()
        for k in range(1, bits):  # every sub-cube of the grid is one run of the curve
            cube = (grid >> k) @ (1 << bits * np.arange(d))
            assert all(np.ptp(h[cube == c]) == (1 << k * d) - 1 for c in np.unique(cube))


def plain_hilbert(n):
    """Places of a curve through an n x n grid, drawn by halves: each quarter is a smaller curve, turned to meet its neighbours."""
    if n == 1:
        return [(0, 0)]
    q, m = plain_hilbert(n // 2), n // 2
    return [(y, x) for x, y in q] + [(x, y + m) for x, y in q] + [(x + m, y + m) for x, y in q] + [(2 * m - 1 - y, m - 1 - x) for x, y in q]


def test_hilbert_curve_is_that_drawn_by_halves():
    for bits in (1, 2, 3, 5):
        way = np.array(plain_hilbert(1 << bits))
        own = sharding.hilbert_index(way, bits)
        turned = sharding.hilbert_index(way[:, ::-1], bits)
        assert any(np.array_equal(x, np.arange(len(way))) for x in (own, turned))


def test_shards_hold_all_rows(spark):
    rows = sharding.op4_sharding(spark, SF).collect()
    want = docs(spark)
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert all(r["size"] == len(want[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(want[r.doc_id].encode()) for r in rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    ends = []
    for s in range(16):
        assert sorted(r.slot for r in shards[s]) == list(range(len(shards[s])))
        by_slot = [r.hilbert for r in sorted(shards[s], key=lambda r: r.slot)]
        assert by_slot == sorted(by_slot)
        ends += [by_slot[0], by_slot[-1]]
    assert ends == sorted(ends)


def test_shards_of_odd_rows(spark, tmp_path):
    placed = sharding.assign_shards(odd(spark), shards=3)
    rows = placed.collect()
    assert len(rows) == len(ODD) and Counter(r.shard for r in rows) in ({0: 3, 1: 3, 2: 2}, {0: 3, 1: 2, 2: 3}, {0: 2, 1: 3, 2: 3})
    assert sharding.assign_shards(odd(spark).limit(0)).count() == 0
    some = odd(spark).withColumn("size", F.lit("clash")).withColumn("lang", F.lit("en")).unionByName(spark.createDataFrame([(None, None), (4, "two")], "doc_id long, text string"), True)
    index = sharding.write_shards(some, f"file://{tmp_path}/s", shards=4).collect()
    files = spark.read.parquet(f"file://{tmp_path}/s")
    assert files.columns == ["doc_id", "text", "N_Words", "lang", "size", "text_crc32", "hilbert", "slot", "shard"]
    assert Counter((r.doc_id, r.text) for r in files.collect()) == Counter([*ODD, (None, None), (4, "two")])
    assert {r.shard: r.n for r in index} == {r.shard: r.n for r in files.groupBy("shard").agg(F.count("*").alias("n")).collect()} and sorted(r.n for r in index) == [2, 2, 3, 3]
    # shards and slots are those of assign_shards()
    place = lambda d: Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in d.collect())
    assert place(files) == place(sharding.assign_shards(some, shards=4))
    assert sharding.write_shards(some.limit(0), f"file://{tmp_path}/e").count() == 0


# near-duplicates


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    if not w:
        return 0
    runs = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    keys, f = list(prints), np.array(list(prints.values()), np.uint64)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = find(k), find(keys[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_matches_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, SF).collect()}
    prints = {k: brute_fingerprint(t) for k, t in docs(spark).items()}
    root = brute_components(prints)
    assert got == {k: (f"{prints[k]:016x}", root[k]) for k in prints}
    assert len(set(root.values())) < len(root)


def test_anchors_cover_all_near_pairs():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)
    x[:5] = [0, 1, 0x80000000, 0xFFFFFFFF, 0x7FFFFFFF]
    home = simhash.home_anchor(x)
    assert (np.bitwise_count(home ^ x) <= 1).all() and (simhash._syndromes(home) == 0).all()
    rows, far = simhash.replica_anchors(x)
    near = defaultdict(set)
    for r, a in zip(rows.tolist(), far.tolist(), strict=True):
        assert np.bitwise_count(np.uint32(a) ^ x[r]) <= 2
        near[r].add(a)
    for k, v in enumerate(x.tolist()):
        flips = np.array([v] + [v ^ (1 << b) for b in range(32)], np.uint32)
        assert set(simhash.home_anchor(flips).tolist()) <= near[k] | {int(home[k])}


@pytest.mark.parametrize(("homes", "most"), [(4096, 1 << 17), (3, 1 << 17), (2, 5)])
def test_links_connect_clusters(spark, homes, most):
    rng = random.Random(7)
    prints = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        prints.add(c)
        for _ in range(rng.randint(0, 30)):
            for _ in range(rng.randint(1, 4)):
                c ^= 1 << rng.randrange(64)
            prints.add(c)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.fingerprint_links(fps, anchor_homes=homes, anchor_rows=most)
    got = {r.node: r.label for r in connected_components(links).collect()}
    want = brute_components({p: p % (1 << 64) for p in prints})
    assert {p: got.get(p, p) for p in prints} == want


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.deduplicate(odd(spark))
    assert kept.columns == ["doc_id", "text", "shard", "N_Words"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, None, 7])
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_deduplication_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = lambda: sorted(map(str, simhash.deduplicate(odd(spark)).collect()))
    few = rows()
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    assert few == rows() and len(few) == 5


@pytest.mark.parametrize("bound", [simhash.BROADCAST_ROWS, 3, -1])
@pytest.mark.parametrize("hot", [simhash.HOT_ROWS, 1])
def test_deduplication_judges_each_row(spark, monkeypatch, bound, hot):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(rng.choice("abcdefghij") * 4 for _ in range(60)) for _ in range(6))
    # null keys with unrelated texts, two texts under key 1, key 2 alone in one group and a copy in another, exact copies
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (2, e), (2, e), (3, f), (4, f), (None, f)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.deduplicate(df).collect())
    assert got == Counter([(None, a), (None, b), (1, c), (1, d), (2, e), (3, f)])


@pytest.mark.parametrize("turn", [1, -1])
def test_components_of_long_paths_take_few_rounds(spark, turn):
    n, rounds = 10_000, []
    edges = spark.range(n).select((F.col("id") * turn).alias("u"), ((F.col("id") + 1) * turn).alias("v"))
    labels = connected_components(edges, rounds).groupBy("label").count().collect()
    assert [tuple(r) for r in labels] == [(min(0, n * turn), n + 1)] and len(rounds) <= 22 and rounds == sorted(rounds, reverse=True)


def test_lookup_of_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id")
    found = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {(r.id, r.v) for r in rows.join(found, "k", "left").collect()}
    got = lookup(rows, found, "k", hot_keys=10, hot_rows=100)
    assert {(r.id, r.v) for r in got.collect()} == want and got.count() == 3000


def test_nothing_but_the_result_stays(spark, tmp_path):
    from orospark.llm.common import shared_dir

    left = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", left()
    at = spark.conf.get(key)
    with scratch(spark):
        simhash.deduplicate(odd(spark)).write.parquet(f"file://{tmp_path}/d")
        simhash.op10_simhash(spark, "/root/testdata/sf0.001").write.parquet(f"file://{tmp_path}/s")
        packing.pack_documents(odd(spark), tokenizer_path("word_bpe_49k.json")).write.parquet(f"file://{tmp_path}/p")
    assert left() == before and spark.conf.get(key) == at
    assert spark.read.parquet(f"file://{tmp_path}/d").count() == 5


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(0, 300)] + [(1000 + k, 1000) for k in range(1, 400)] + [(5, 5)]
    random.Random(1).shuffle(path)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(400)}
