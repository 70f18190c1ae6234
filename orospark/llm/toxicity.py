"""Toxicity by weak supervision: voters, a generative label model with correlations, and a linear classifier on its posterior."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import discard, give_memory_back, map_texts, materialise, slices, start_task, table

#: Labelled documents that voters and classifier are fitted on at most: a sample chosen by a hash of the key.
FIT_DOCS = 12_000
#: Entries of the learned lexicon, the candidates that they are chosen from, and the voters that share them.
ENTRIES = 96
CANDIDATES = 4000
LEARNED_VOTERS = 7
#: Documents that an entry has to add, those already covered counting less.
FRESH = 3.0
#: Pairs of voters with a correlation of their own.
PAIRS = 8

#: Insults that a voter starts with, whatever the labels say.
INSULTS = "asshole bastard bitch clown creep cretin degenerate disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic parasite pathetic pig retard scum scumbag shit shut sleazy slut stupid subhuman swine trash trashy ugly vermin vile whore worm worthless".split()
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KEEP_LEET = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c in b"@$" or c >= 128 else 32 for c in range(256))
_SECOND = re.compile(rb"\b(you|your|youre|ur|du|ihr|tu|vous|usted)\b")


def word_set(text: bytes | None) -> tuple[set[bytes], bytes]:
    """Distinct words in lower case, letters only, and the lower-case text."""
    low = (text or b"").decode("utf-8", "replace").lower().encode()
    return set(low.translate(_KEEP).split()), low


def _prefixes(word: bytes) -> list[bytes]:
    """Openings of 4 to 8 characters of a longer word, marked as such."""
    w = word.decode("utf-8", "replace")
    return [w[:k].encode() + b"*" for k in range(4, min(9, len(w)))]


#: Word and opening counts that a task gathers before it sends them on.
FLUSH = 100_000


def _entries(text: bytes | None) -> set[bytes]:
    return {x for w in word_set(text)[0] for x in (w, *_prefixes(w))}


def entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, pos, neg): how many toxic and other texts of the sample have each word and opening, added up in the tasks first."""

    def run(batches):
        start_task()
        held: list[Counter] = [Counter(), Counter()]

        def out():
            names = list(held[0].keys() | held[1].keys())
            columns = [pa.array(names, pa.binary()), *(pa.array([c[n] for n in names], pa.int64()) for c in (held[1], held[0]))]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["entry", "pos", "neg"])

        for batch in batches:
            for text, y in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update(_entries(text))
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield out()
        yield out()
        del held[:]
        give_memory_back()

    return sample.select("text", "y").mapInArrow(run, "entry binary, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def mine_lexicon(sample: DataFrame, most: int = ENTRIES, candidates: int = CANDIDATES) -> list[bytes]:
    """Words, and openings of words (with *), that toxic texts have and others hardly do, each adding texts not yet covered.

    sample: (text, y). Counting is Spark's; the driver sees the best candidates, and which toxic texts have which."""
    n0, n1 = (sample.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()) or (0, 0)
    least = max(4, n1 // 400)  # fewer may be chance, or copies of one text
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (max(1, n0) + 1))
    good = entry_counts(sample).where(F.col("pos") >= least).withColumn("odds", odds).where("odds > 2.5 and neg <= 0.25 * pos")
    best = good.orderBy(F.desc(F.col("pos") * F.col("odds")), "entry").limit(candidates).collect()
    odds_of = {bytes(r.entry): r.odds for r in best}
    if not best:
        return []

    def held(batches):
        for batch in batches:
            found = [[x for x in _entries(t) if x in odds_of] for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["found"])

    found = sample.where("y = 1").select("text").mapInArrow(held, "found array<binary>").toArrow().column("found").to_pylist()
    holders: dict[bytes, list[int]] = {f: [] for f in odds_of}
    for k, f in enumerate(found):
        for x in f:
            holders[x].append(k)
    return cover(odds_of, {f: np.array(h, np.intp) for f, h in holders.items()}, len(found), most)


def cover(odds: dict[bytes, float], rows: dict[bytes, np.ndarray], n: int, most: int = ENTRIES) -> list[bytes]:
    """Entries, best first, each by its odds times the texts that it adds; texts that entries already cover count less."""
    left = sorted(odds, key=lambda f: (-len(rows[f]) * odds[f], f))
    taken, times = [], np.zeros(n)
    while left and len(taken) < most:
        best, gain = None, 0.0
        for f in left:  # by falling bound on the gain
            if len(rows[f]) * odds[f] <= gain:
                break
            fresh = float((1 / (1 + 3 * times[rows[f]])).sum())
            g = odds[f] * fresh
            if g > gain and fresh >= FRESH:
                best, gain = f, g
        if best is None:
            break
        taken.append(best)
        times[rows[best]] += 1
        stem = best.rstrip(b"*")
        # longer or shorter openings of the same words add nothing
        left = [f for f in left if f != best and not (_akin(f.rstrip(b"*"), stem) and min(len(rows[f]), len(rows[best])) > 0.6 * max(len(rows[f]), len(rows[best])))]
    return taken


def _akin(a: bytes, b: bytes) -> bool:
    return a.startswith(b) or b.startswith(a)


@dataclass
class Lexicon:
    """Learned entries and built-in insults; hits of a document are the numbers of its entries."""

    entries: list[bytes]
    ids: dict[bytes, int] = field(default_factory=dict)
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.ids:
            every = list(dict.fromkeys([*self.entries, *(w.encode() for w in INSULTS)]))
            self.ids = {f: k for k, f in enumerate(every)}
        self.insults = {self.ids[w.encode()] for w in INSULTS}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > 150_000:
                self.known.clear()
            hit = self.known[word] = tuple(self.ids[x] for x in (word, *_prefixes(word)) if x in self.ids)
        return hit

    def hits(self, words: set[bytes]) -> list[int]:
        of, out = self.of_word, set()
        for w in words:
            if h := of(w):
                out.update(h)
        return sorted(out)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


#: Pattern voters, after those of the learned lexicon and the built-in one.
PATTERNS = ("two_hits", "dense_hits", "spelt_around", "second_person", "shouting", "no_hit")


def describe(text: bytes | None, lexicon: Lexicon) -> tuple[list[int], list[float]]:
    """Lexicon hits and (log words, share of hits, spelt-around hits, second person, capitals) of a whole text."""
    words, low = word_set(text)
    hits = lexicon.hits(words)
    n = len(words)
    around = 0
    if any(c in low for c in (b"0", b"1", b"3", b"4", b"5", b"7", b"@", b"$")):
        mixed = {w for w in low.translate(_KEEP_LEET).split() if 4 <= len(w) <= 24 and w.isascii() and not w.isalpha() and any(97 <= c <= 122 for c in w)}
        around = sum(bool(lexicon.of_word(w.strip(b"$@").translate(_LEET))) for w in mixed if w.strip(b"$@") and not w.strip(b"$@").isalpha())
    raw = text or b""
    letters = sum(map(raw.count, (b"E", b"A", b"I", b"N", b"T")))
    small = sum(map(raw.count, (b"e", b"a", b"i", b"n", b"t")))
    return hits, [math.log1p(n), len(hits) / (n + 5), float(min(around, 5)), 1.0 if hits and _SECOND.search(low) else 0.0, letters / (letters + small + 1)]


def votes(hits: list[int], stats: list[float], lexicon: Lexicon) -> int:
    """The voters that speak up, as bits: learned lexicons, built-in lexicon, patterns."""
    n_learned, out = len(lexicon.entries), 0
    for h in hits:
        if h < n_learned:
            out |= 1 << (h % LEARNED_VOTERS)
    at = LEARNED_VOTERS
    on = (any(h in lexicon.insults for h in hits), len(hits) >= 2, stats[1] > 0.01 and len(hits) > 0, stats[2] > 0, stats[3] > 0, stats[4] > 0.5, not hits)
    for k, x in enumerate(on):
        out |= int(x) << (at + k)
    return out


N_VOTERS = LEARNED_VOTERS + 1 + len(PATTERNS)


class LabelModel:
    """log p(votes | y) = accuracies of the voters for each class + correlations of chosen pairs, normalised over all 2^voters
    patterns; fitted by EM on the histogram of patterns, some of which come with labels."""

    def __init__(self, n: int = N_VOTERS):
        self.n = n
        patterns = np.arange(1 << n)
        self.x = ((patterns[:, None] >> np.arange(n)) & 1).astype(float)

    def fit(self, counts: np.ndarray, labelled: np.ndarray, n_pairs: int = PAIRS, rounds: int = 25, steps: int = 40) -> np.ndarray:
        """counts: documents of each pattern; labelled (2, patterns): of them with label 0 and 1. Returns the posterior of each pattern."""
        x, n = self.x, self.n
        free = np.maximum(counts - labelled.sum(0), 0.0)
        total = max(counts.sum(), 1.0)
        prior = (labelled[1].sum() + 1) / (labelled.sum() + 2)
        rate = lambda c: (c @ x + 0.5) / (c.sum() + 1)
        theta = np.stack([np.log(r / (1 - r)) for r in (rate(labelled[0]), rate(labelled[1]))])
        # pairs that move together most, given the label
        phi = np.zeros((n, n))
        for c in labelled:
            p = c / max(c.sum(), 1)
            m = p @ x
            cov = (x * p[:, None]).T @ x - np.outer(m, m)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-4))
            phi += np.abs(cov / np.outer(sd, sd))
        a, b = np.triu_indices(n, 1)
        top = np.argsort(-phi[a, b], kind="stable")[:n_pairs]
        pair = x[:, a[top]] * x[:, b[top]]
        f = np.concatenate([x, pair], axis=1)
        w = np.concatenate([theta, np.zeros((2, pair.shape[1]))], axis=1)
        post = np.full(len(counts), prior)
        for _ in range(rounds):
            logit = np.log(prior / (1 - prior)) + self._log(f, w[1]) - self._log(f, w[0])
            post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            # labels are right but for one in twenty
            of1 = 1 / (1 + np.exp(-np.clip(logit + math.log(19), -40, 40)))
            of0 = 1 / (1 + np.exp(-np.clip(logit - math.log(19), -40, 40)))
            q1 = free * post + labelled[1] * of1 + labelled[0] * of0
            q = (counts - q1, q1)
            prior = float(np.clip(q1.sum() / total, 1e-4, 0.9))
            for y in (0, 1):
                want = (q[y] @ f + 0.01) / (q[y].sum() + 0.02)
                for _ in range(steps):
                    p = np.exp(self._log(f, w[y]))
                    have = p @ f
                    w[y] += 0.8 * (want - have) / np.maximum(have * (1 - have), 0.02) * 0.25 - 1e-4 * w[y]
                    w[y] = np.clip(w[y], -12, 12)
        self.weights, self.pairs, self.prior = w, list(zip(a[top].tolist(), b[top].tolist(), strict=True)), prior
        return post

    @staticmethod
    def _log(f: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = f @ w
        top = s.max()
        return s - top - np.log(np.exp(s - top).sum())


@dataclass
class LinearModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    posterior: np.ndarray

    def score(self, hits: list[list[int]], stats: np.ndarray) -> np.ndarray:
        z = features(hits, stats, len(self.lexicon.ids)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def features(hits: list[list[int]], stats: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((len(hits), n + 9))
    for k, h in enumerate(hits):
        x[k, h] = 1
    many = x[:, :n].sum(1)
    x[:, n] = many > 0
    x[:, n + 1] = np.log1p(many)
    x[:, n + 2 : n + 7] = stats
    x[:, n + 7] = many >= 2
    x[:, n + 8] = (many > 0) * (1 - np.minimum(stats[:, 0], 8) / 8)
    return x


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (target - p) - penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def is_held_out(key: str = "doc_id"):
    """crc32 of the key as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, y) of at most ``most`` labelled documents that are not held out: those with the least hashes of the key.

    A key with several labels has the highest, one with several texts the least of them; null keys and labels other than 0
    and 1 are left out."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64(key, F.lit(3)), key).limit(most)
    found = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(rows), key)
    return found.groupBy(key).agg(F.min("_text").alias("text"), F.first("_y").alias("y")).select("text", "y")


def fit_lexicon(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the sample (text, y) that it was mined from, written to the shared folder."""
    sample = materialise(training_sample(docs, labels, "toxic", fit_docs, text, key))
    return Lexicon(mine_lexicon(sample)), sample


def describe_all(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with _hits, _stats and _votes, one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = [T.StructField("_hits", T.ArrayType(T.IntegerType())), T.StructField("_stats", T.ArrayType(T.DoubleType())), T.StructField("_votes", T.IntegerType())]

    def make():
        lexicon = shared.value

        def f(texts):
            found = [describe(t, lexicon) for t in texts]
            return [[h for h, _ in found], [s for _, s in found], [votes(h, s, lexicon) for h, s in found]]

        return f

    return map_texts(docs, make, fields, text, keep_text)


def fit(described: DataFrame, lexicon: Lexicon, sample: DataFrame) -> LinearModel:
    """Label model on the vote patterns of all documents, of which at most 2^voters kinds reach the driver; classifier on its
    posterior. Of the sample only hits, numbers and votes reach the driver; it is deleted."""
    counts = np.zeros(1 << N_VOTERS)
    for r in described.groupBy("_votes").count().collect():
        counts[r[0]] = r[1]
    found = sorted(map(tuple, describe_all(sample, lexicon).select("_hits", "_stats", "_votes", "y").collect()))
    discard(sample)
    hits, stats = [f[0] for f in found], np.array([f[1] for f in found]).reshape(-1, 5)
    masks, y = np.array([f[2] for f in found], np.int64), np.array([f[3] for f in found], np.int64)
    labelled = np.zeros((2, len(counts)))
    np.add.at(labelled, (y, masks), 1.0)
    counts = np.maximum(counts, labelled.sum(0))
    posterior = LabelModel().fit(counts, labelled)
    w, b = fit_linear(features(hits, stats, len(lexicon.ids)), posterior[masks]) if len(y) else (np.zeros(len(lexicon.ids) + 9), -3.0)
    return LinearModel(lexicon, w, b, posterior)


def with_scores(described: DataFrame, model: LinearModel) -> DataFrame:
    """described with score and predicted instead of its descriptions."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    gone = ("_hits", "_stats", "_votes")
    schema = T.StructType([f for f in described.schema.fields if f.name not in (*gone, "score", "predicted")] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                rows = b.slice(at, 2000)
                get = lambda n: rows.column(rows.schema.get_field_index(n))  # noqa: B023, E731
                score = model.score(get("_hits").to_pylist(), np.array(get("_stats").to_pylist()).reshape(-1, 5))
                yield pa.RecordBatch.from_arrays([*(get(n) for n in schema.names[:-2]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return described.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score and predicted of all docs, learned from the labels of documents that are not held out.

    A null or empty text has no words and a low score; very long texts are read whole; repeated rows each get the score of
    their text; labels other than 0 and 1 are left out, an empty label table leaves the built-in lexicon without training
    (scores under 0.5); other columns of docs go, so none can clash; an empty table stays empty."""
    lexicon, sample = fit_lexicon(docs, labels, text, key)
    described = materialise(describe_all(docs.select(key, text), lexicon, text))
    return with_scores(described, fit(described, lexicon, sample))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those predicted toxic; all columns stay, whatever their names. The score is computed again from each text,
    so no key has to be unique; odd rows are scored as in score_documents(), so null and empty texts stay."""
    lexicon, sample = fit_lexicon(docs, labels, text, key)
    described = describe_all(docs.select(text), lexicon, text).select("_votes")
    shared = docs.sparkSession.sparkContext.broadcast(fit(described, lexicon, sample))
    at = docs.columns.index(text)

    def run(batches):
        start_task()
        model = shared.value
        for batch in batches:
            for rows, texts in slices(batch, at):
                found = [describe(t, model.lexicon) for t in texts]
                score = model.score([h for h, _ in found], np.array([s for _, s in found]).reshape(-1, 5))
                yield rows.filter(pa.array(score < 0.5))
        give_memory_back()

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of each document; odd rows as in score_documents()."""
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
