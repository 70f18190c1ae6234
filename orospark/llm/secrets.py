"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orospark.llm.common import give_memory_back, map_texts, slices, start_task, table
from orospark.llm.spans import SECRET_KINDS, Span, Taken, by_start, digest, find_secrets, written

#: A candidate: a run of so many characters that secrets are written in, at least.
LEAST = 16
#: Labelled samples of random strings (all kinds) and of ordinary identifiers.
FIT_SAMPLES = 12_000
#: Log-likelihood ratio per character over which a run is taken for random; see the README for both sides' distances from it.
THRESHOLD = 0.7
ADDED = "random"

_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_RUN_BYTES = re.compile(_RUN.pattern.encode())
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(256, len(_ALPHABET), np.intp)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
#: Kinds of random strings that have a model each.
RANDOM_KINDS = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": _ALPHABET[:62],
    "base64": _ALPHABET[:64],
    "url": _ALPHABET[:62] + "_-",
}
#: Words that identifiers are made of, beside those of the corpus.
IDENTIFIER_WORDS = "account add address all array base buffer build byte cache call check client code config connection content context count create data date default delete device error event factory field file filter find format get group handler hash header html http id image index info input int item json key label last length line list load local manager map max message method min model module name new next node number object option order output page path password pipeline print process property query read record request response result row save schema select server service session set size source start state status string system table task test text time title token total type update url user utils value version view width window world write xml".split()


def random_samples(n: int, seed: int = 11) -> list[tuple[str, str]]:
    """n labelled random strings (kind, text) of each kind, the same each time."""
    rng = random.Random(seed)
    return [(kind, "".join(rng.choices(letters, k=rng.randint(LEAST, 64)))) for kind, letters in RANDOM_KINDS.items() for _ in range(n)]


def ordinary_samples(words: list[str], n: int, seed: int = 12) -> list[str]:
    """n labelled identifiers: single words, words run together, and the usual ways of joining them, with numbers, dates and paths."""
    rng = random.Random(seed)
    words, out = [w for w in words if w] or IDENTIFIER_WORDS, []
    for k in range(n):
        w = [rng.choice(words if rng.random() < 0.6 else IDENTIFIER_WORDS) for _ in range(rng.randint(1, 5))]
        way = k % 8
        text = ("_".join(w) if way == 0 else "-".join(w) if way == 1 else "/".join(w) if way == 2 else w[0] + "".join(x.title() for x in w[1:]) if way == 3 else "_".join(w).upper() if way == 4 else w[0] if way == 5 else "".join(w) if way == 6 else f"{w[0]}-{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}")
        out.append(text + (str(rng.randint(0, 9999)) if rng.random() < 0.15 else ""))
    return out


@dataclass
class MarkovPair:
    """Log-likelihood ratios of character pairs, random against ordinary, for each kind of random string."""

    ratios: np.ndarray
    threshold: float

    def score(self, run: bytes) -> float:
        """Highest ratio per character over the kinds."""
        c = _CODE[np.frombuffer(run, np.uint8)]
        pairs = np.concatenate([[len(_ALPHABET)], c[:-1]]) * (len(_ALPHABET) + 1) + c
        return float(self.ratios[:, pairs].sum(1).max() / len(run))

    def is_random(self, run: bytes) -> bool:
        """Runs without a letter are numbers, not secrets."""
        return run.translate(None, b"0123456789+/_=-") != b"" and self.score(run) > self.threshold


def _pair_counts(samples: list[str]) -> np.ndarray:
    k = len(_ALPHABET) + 1
    counts = np.zeros(k * k)
    for s in samples:
        c = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        counts += np.bincount(np.concatenate([[k - 1], c[:-1]]) * k + c, minlength=k * k)
    return counts.reshape(k, k)


def _log_model(p: np.ndarray, smooth: float) -> np.ndarray:
    """Log probability of each character after each, from counts; rare ones lean on how common the character is."""
    unigram = (p.sum(0) + 0.5) / (p.sum() + 0.5 * len(p))
    return np.log((p + smooth * unigram) / (p.sum(1, keepdims=True) + smooth))


def corpus_letters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter follows each in the ASCII words of all docs, in lower case; the last row and column stand for a
    word's start and end. Tasks add up 27 x 27 numbers each, whatever the texts."""

    def run(batches):
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for _, texts in slices(batch, 0):
                c = _LETTER[np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b""]), np.uint8)]
                total += np.bincount(c[:-1] * 27 + c[1:], minlength=27 * 27)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], names=["pair", "n"])

    out = np.zeros(27 * 27)
    for r in docs.select(text).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    out[-1] = 0  # what isn't a word
    return out.reshape(27, 27)


_LETTER = np.full(256, 26, np.intp)
_LETTER[97:123] = _LETTER[65:91] = np.arange(26)


def corpus_identifiers(letters: np.ndarray) -> np.ndarray:
    """Expected character pairs, a word, of identifiers made of the corpus's words in the ways of ordinary_samples()."""
    k = len(_ALPHABET) + 1
    out, words = np.zeros((k, k)), max(letters[26].sum(), 1.0)
    start, end, inner = letters[26, :26] / words, letters[:26, 26] / words, letters[:26, :26] / words
    low, up, more = np.arange(26), np.arange(26, 52), 2 / 3  # three words an identifier: one first, two more
    second = inner / np.maximum(inner.sum(1, keepdims=True), 1e-9)
    for case, join in ((low, "_"), (low, "-"), (low, "/"), (up, "_"), (low, None), (low, "")):
        out[np.ix_(case, case)] += inner
        out[k - 1, case] += start * (1 if join is None else 1 / 3)
        if join:
            j = _ALPHABET.index(join)
            out[j, case] += more * start
            out[case, j] += more * end
        elif join == "":
            out[np.ix_(case, case)] += more * np.outer(end, start)
    # words run together with a capital each but the first
    out[np.ix_(low, low)] += inner
    out[k - 1, low] += start / 3
    out[np.ix_(low, up)] += more * np.outer(end, start)
    out[np.ix_(up, low)] += more * start[:, None] * second
    return out


def fit(random_strings: list[tuple[str, str]], ordinary: list[str], letters: np.ndarray | None = None, threshold: float = THRESHOLD) -> MarkovPair:
    """Both models from labelled samples; that of ordinary identifiers counts the corpus's words as much as its samples."""
    pairs = _pair_counts(ordinary)
    if letters is not None and letters.sum():
        own = corpus_identifiers(letters)
        pairs = pairs + own * (pairs.sum() / own.sum() if pairs.sum() else 1e5)
    common = _log_model(pairs, 20.0).ravel()
    kinds: dict[str, list[str]] = {}
    for kind, s in random_strings:
        kinds.setdefault(kind, []).append(s)
    return MarkovPair(np.stack([_log_model(_pair_counts(s), 400.0).ravel() - common for s in kinds.values()]), threshold)


def fit_on(docs: DataFrame, text: str = "text") -> MarkovPair:
    """Models for docs: the labelled samples are made here, the letters are counted over all texts."""
    return fit(random_samples(FIT_SAMPLES // len(RANDOM_KINDS)), ordinary_samples([], FIT_SAMPLES), corpus_letters(docs, text))


def scan(text: str, model: MarkovPair) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, by start. Runs that overlap a base span add nothing."""
    base = find_secrets(text)
    added, taken = [], Taken(base)
    for m in _RUN.finditer(text):
        if not taken(m.start(), m.end()) and model.is_random(m[0].encode()):
            added.append((ADDED, m.start(), m.end()))
    return base, by_start(base + added, SECRET_KINDS) if added else base


class Scanner:
    """Scans UTF-8 texts; only those with a long run that looks random, or a base match, are walked in full."""

    def __init__(self, model: MarkovPair):
        self.model, self.known = model, {}

    def _suspect(self, text: bytes) -> bool:
        for word in text.split():
            if len(word) >= LEAST:
                for run in _RUN_BYTES.findall(word):
                    if run not in self.known:
                        if len(self.known) > 100_000:
                            self.known.clear()
                        self.known[run] = self.model.is_random(run)
                    if self.known[run]:
                        return True
        return False

    def __call__(self, text: bytes | None) -> tuple[str, list[Span], list[Span]]:
        s = (text or b"").decode("utf-8", "replace")
        if text and self._suspect(text):
            return (s, *scan(s, self.model))
        base = find_secrets(s)
        return s, base, base


def find_spans(docs: DataFrame, model: MarkovPair, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans (base ones and those of the models).

    Null and empty texts have none; very long ones are read whole; repeated rows each get their own; clashing columns go;
    an empty table stays empty."""
    long, string = T.LongType(), T.StringType()
    fields = [*(T.StructField(f"n_{k}", long) for k in SECRET_KINDS), T.StructField("base_sha256", string), T.StructField("spans", string)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scanner = Scanner(shared.value)

        def f(texts):
            found = [scanner(t)[1:] for t in texts]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in SECRET_KINDS]
            return [*counts, [digest(base) for base, _ in found], [written(every) for _, every in found]]

        return f

    return map_texts(docs, make, fields, text, keep_text)


def mask(docs: DataFrame, model: MarkovPair, text: str = "text", with_: str = "[SECRET]") -> DataFrame:
    """docs with each span of secrets replaced, spans that overlap by one mark; all rows stay, null and empty texts, texts
    without secrets and other columns, whatever their names, as they are."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        start_task()
        scanner = Scanner(shared.value)
        for batch in batches:
            for rows, texts in slices(batch, at):
                new = []
                for t in texts:
                    s, _, spans = scanner(t)
                    out, to = [], 0
                    for _, a, b in spans:
                        if b > to:
                            out += [s[to:a], with_] if a >= to else []
                            to = max(to, b)
                    new.append(None if t is None else "".join([*out, s[to:]]))
                yield rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type))
        give_memory_back()

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in each document; odd rows as in find_spans()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_spans(docs, fit_on(docs), keep_text=False)
