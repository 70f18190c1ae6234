"""Base finders of personal data and secrets, and how their spans are written."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

Span = tuple[str, int, int]

PII_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")  # a match starts where digits start; no way back
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of local part, @ and domain, from each @: linear also in long runs without one."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def find_pii(text: str) -> list[Span]:
    """Base spans, by kind as listed and start."""
    out = emails(text)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def find_secrets(text: str) -> list[Span]:
    """Base spans, by start and kind as listed."""
    low, out = text.lower(), []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return by_start(out, SECRET_KINDS)


def _place(kind: str, kinds: tuple[str, ...]) -> int:
    return kinds.index(kind) if kind in kinds else len(kinds)


def by_start(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _place(s[0], kinds), s[2]))


def by_kind(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (_place(s[0], kinds), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


class Taken:
    """Whether a stretch overlaps any of some spans."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and self.ends[k] > start

    def add(self, start: int, end: int) -> None:
        """A stretch that overlaps none so far."""
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)
