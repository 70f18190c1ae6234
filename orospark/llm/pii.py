"""Personal data by a skip-chain conditional random field over the mentions of a document."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orospark.llm.common import map_texts, table
from orospark.llm.spans import PII_KINDS, Span, Taken, LOCAL, by_kind, digest, find_pii, luhn, written

LABELS = ("none", *PII_KINDS)
ROUNDS = 30
DAMPING = 0.3
#: Rounds before the leanings of unlabelled mentions count in full; potentials below -HARD rule a label out.
WARM_ROUNDS, HARD = 6, 6.0
#: Mentions so far apart, in characters, have no chain edge.
NEAR = 80

_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[0-9]|[.()/:_\x20-]{1,3}+(?=[0-9])){5,}")
_AT = re.compile(r"[(\[{]at[)\]}]|@|\x20at\x20", re.I)
_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+)+", re.I)
_HANDLE_PART = re.compile(r"[A-Za-z0-9._%+-]{5,}")
_CUE = {
    "email": re.compile(r"e-?mail|mail|contact|write to|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|whatsapp|sms|téléphone|teléfono|telefon", re.I),
}


@dataclass
class Weights:
    """Log potentials. Features fire for one label each; edges reward equal labels."""

    base: float = 12.0  # a base match has its label
    none: float = 2.0
    cue: float = 2.5  # a word before it tells the kind
    bracketed_email: float = 4.5  # "(at)", "[dot]"
    digits_card: float = 1.0  # 13 to 19 digits
    luhn_card: float = 3.0
    digits_phone: float = 0.5  # 9 to 15 digits
    grouped_phone: float = 1.0  # and brackets, or groups that end in four
    dotted_ip: float = 0.5
    handle_email: float = 0.0
    chain: float = 0.3
    same: float = 4.0  # skip edge: equal after dropping marks
    similar: float = 2.75  # skip edge: one ends in the other's last nine digits


@dataclass
class Mention:
    start: int
    end: int
    kind: str | None  # of a base match
    form: str  # digits, or lower case letters and digits


def spelt_out(text: str) -> list[tuple[int, int]]:
    """Addresses with marks or words for @ and dots, or spaces around them, from each sign for @: linear, of any length."""
    out, end = [], 0
    for m in _AT.finditer(text):
        at = m.start() - (text[max(end, m.start() - 1) : m.start()] == " ")
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, m.end())):
            out.append((start, d.end()))
            end = d.end()
    return out


def mentions(text: str, base: list[Span]) -> list[Mention]:
    """Base matches, other runs of digits, spelt-out addresses, and later uses of a base address's local part."""
    out = [Mention(a, b, k, _form(text[a:b], k)) for k, a, b in base]
    taken = Taken(base)
    more = [(m.start(), m.end(), None) for m in _NUMBER.finditer(text)] + [(a, b, "email") for a, b in spelt_out(text)]
    out += [Mention(a, b, None, _form(text[a:b], k)) for a, b, k in more if not taken(a, b)]
    handles = {text[a:b].partition("@")[0] for k, a, b in base if k == "email"}
    handles = {h for h in handles if _HANDLE_PART.fullmatch(h) and any(c.isdigit() or c in "._" for c in h.strip("._"))}
    if handles:
        taken = Taken([("", m.start, m.end) for m in out])
        for m in _HANDLE_PART.finditer(text):
            h = m[0].rstrip(".-")
            if h in handles and not taken(m.start(), m.start() + len(h)):
                out.append(Mention(m.start(), m.start() + len(h), None, "@" + h.lower()))
    return sorted(out, key=lambda m: (m.start, m.end))


def _form(s: str, kind: str | None) -> str:
    if kind == "email":
        s = re.sub(r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?", "@", s.lower())
        return re.sub(r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?", ".", s)
    if kind == "ip":
        return s
    return "".join(c for c in s if "0" <= c <= "9")


def unary(text: str, m: Mention, w: Weights) -> np.ndarray:
    u = np.zeros(len(LABELS))
    if m.kind:
        u[LABELS.index(m.kind)] = w.base
        return u
    email, ip, card, phone = 1, 2, 3, 4
    s = text[m.start : m.end]
    u[0] = w.none
    if m.form[:1] == "@":
        u[email] += w.handle_email
        u[[ip, card, phone]] -= w.base
    elif "@" in m.form:
        spelt = re.search(r"[\[({](at|dot)[\])}]", s, re.I) or "@" in s
        u[email] += w.bracketed_email if spelt else 0.0
        u[[ip, card, phone]] -= w.base
    else:
        n = len(m.form)
        u[email] -= w.base
        u[ip] += w.dotted_ip if s.count(".") == 3 and n <= 12 else -w.base
        u[card] += (w.digits_card + (w.luhn_card if luhn(m.form) and re.search(r"[./_]", s) else 0)) if 13 <= n <= 19 else -w.base
        u[phone] += (w.digits_phone + (w.grouped_phone if re.search(r"\(\d+\)|\D\d{4}$", s) else 0)) if 9 <= n <= 15 else -w.base
    before = text[max(0, m.start - 24) : m.start]
    for k, cue in _CUE.items():
        if cue.search(before):
            u[LABELS.index(k)] += w.cue
    return u


def edges(found: list[Mention], w: Weights) -> list[tuple[int, int, float]]:
    """Chain edges between neighbours, and skip edges: equal or similar mentions (numbers that end in the same nine
    digits, addresses with the same local part) are tied to the one before and to the first, so a mention repeated n times costs 2n edges, not all pairs."""
    out = [(k, k + 1, w.chain) for k in range(len(found) - 1) if found[k + 1].start - found[k].end <= NEAR]
    for weight, key in ((w.same, lambda m: (m.form, "")), (w.similar, lambda m: ("", m.form[-9:]) if len(m.form) >= 9 and m.form.isdigit() else None), (w.same, lambda m: ("@", m.form.lstrip("@").partition("@")[0]) if "@" in m.form else None)):
        groups: dict = defaultdict(list)
        for k, m in enumerate(found):
            if m.form and (g := key(m)) is not None:
                groups[g].append(k)
        for g in groups.values():
            anchor = next((k for k in g if found[k].kind), g[0])
            for a, b in zip(g, g[1:], strict=False):
                out.append((a, b, weight))
            out += [(min(anchor, k), max(anchor, k), weight) for k in g if k != anchor]
    return list(dict.fromkeys(out))


def propagate(u: np.ndarray, pairs: list[tuple[int, int, float]], rounds: int = ROUNDS, damping: float = DAMPING, sure: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy sum-product; each edge multiplies equal labels by the exponential of its weight.

    With ``sure`` (rows whose label is known), the others' own leanings come in over the first rounds, so that what
    is known travels first and a crowd of weakly leaning repeats doesn't talk itself into the wrong label."""
    n, k = u.shape
    if not pairs:
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b, w = (np.array(x) for x in zip(*pairs, strict=True))
    src, dst, gain = np.concatenate([a, b]), np.concatenate([b, a]), np.expm1(np.concatenate([w, w]))[:, None]
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    m = np.zeros((len(src), k))
    for r in range(rounds):
        part = 1.0 if sure is None else min(1.0, r / WARM_ROUNDS)
        belief = u.copy() if part == 1.0 else np.where(sure[:, None] | (u < -HARD), u, part * u)
        np.add.at(belief, dst, m)
        out = belief[src] - m[back]
        p = np.exp(out - out.max(1, keepdims=True))
        new = np.log(p.sum(1, keepdims=True) + gain * p)
        new -= new.max(1, keepdims=True)
        step = np.abs(new - m).max()
        m = damping * m + (1 - damping) * new
        if step < 1e-4 and part == 1.0:
            break
    belief = u.copy()
    np.add.at(belief, dst, m)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def scan(text: str, w: Weights | None = None, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) by kind and start. A mention joins when its label's marginal is over the threshold."""
    w = w or Weights()
    base = find_pii(text)
    found = mentions(text, base) if base or _DIGIT_RUN.search(text) or _AT.search(text) else []
    if not any(m.kind is None for m in found):
        return base, base
    p = propagate(np.stack([unary(text, m, w) for m in found]), edges(found, w), sure=np.array([m.kind is not None for m in found]))
    added, taken = [], Taken(base)
    for m, q in sorted(zip(found, p, strict=True), key=lambda x: -x[1][1:].max()):
        k = int(q[1:].argmax()) + 1
        if m.kind is None and q[k] > threshold and not taken(m.start, m.end):
            added.append((LABELS[k], m.start, m.end))
            taken.add(m.start, m.end)
    return base, by_kind(base + added, PII_KINDS) if added else base


def fit_weights(labelled: list[tuple[str, list[Span]]], start: Weights | None = None, rounds: int = 200, rate: float = 0.5, pull: float = 0.02) -> Weights:
    """Weights from labelled texts, by pseudo-likelihood: each mention given the labels of those it is tied to.

    labelled holds texts with the true spans of all kinds; mentions on none of them are "none". Weights are pulled
    towards the start, so features that the labels don't show keep their values; base stays as it is."""
    start = start or Weights()
    unary_names = [f.name for f in fields(Weights) if f.name not in ("base", "chain", "same", "similar")]
    edge_names = ["chain", "same", "similar"]
    none = replace(start, **{n: 0.0 for n in [*unary_names, *edge_names]})
    base, phi, gold = [], [], []
    for text, spans in labelled:
        truth = {(a, b): LABELS.index(k) for k, a, b in spans}
        # base matches are context: labels that neighbours see, not what is learned from
        found = mentions(text, find_pii(text))
        y = [truth.get((m.start, m.end), LABELS.index(m.kind) if m.kind else 0) for m in found]
        ties = {n: edges(found, replace(none, **{n: 1.0})) for n in edge_names}
        for k, m in enumerate(found):
            if m.kind:
                continue
            u0 = unary(text, m, none)
            rows = [unary(text, m, replace(none, **{n: 1.0})) - u0 for n in unary_names]
            for n in edge_names:
                r = np.zeros(len(LABELS))
                for a, b, w in ties[n]:
                    if w and k in (a, b):
                        r[y[b if k == a else a]] += 1.0
                rows.append(r)
            base.append(u0)
            phi.append(np.stack(rows))
            gold.append(y[k])
    if not gold:
        return start
    u0, f, y = np.stack(base), np.stack(phi), np.array(gold)
    names = unary_names + edge_names
    w0 = np.array([getattr(start, n) for n in names])
    w = w0.copy()
    for _ in range(rounds):
        z = u0 + np.einsum("nfk,f->nk", f, w)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own = f[np.arange(len(y)), :, y]
        w += rate * ((own - np.einsum("nfk,nk->nf", f, p)).mean(0) - pull * (w - w0))
        w[len(unary_names) :] = np.maximum(w[len(unary_names) :], 0.0)  # ties never push apart
    return replace(start, **dict(zip(names, w.tolist(), strict=True)))


#: Every mention that mentions() can find without a base match holds one of this or _AT.
_DIGIT_RUN = re.compile(r"[0-9][0-9().\x20/:_-]{5,}")


def find_spans(docs: DataFrame, weights: Weights | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256 and spans (base ones and those of the field).

    Null and empty texts have none; very long ones are read whole; repeated rows each get their own; clashing columns go;
    an empty table stays empty."""
    long, string = T.LongType(), T.StringType()
    columns = [*(T.StructField(f"n_{k}", long) for k in PII_KINDS), T.StructField("base_sha256", string), T.StructField("spans", string)]

    def make():
        def f(texts):
            found = [scan((t or b"").decode("utf-8", "replace"), weights) for t in texts]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in PII_KINDS]
            return [*counts, [digest(base) for base, _ in found], [written(every) for _, every in found]]

        return f

    return map_texts(docs, make, columns, text, keep_text)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in each document; odd rows as in find_spans()."""
    return find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
