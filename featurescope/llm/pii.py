"""Operator 7: personal data by candidate gradient boosting.

*Base* spans follow four fixed patterns (email, ip, card, phone) with their
checks; they always stay.  On top, high-recall generators propose overlapping
spans of five kinds (the four, written loosely, and ``secret``: long mixed
tokens), boosted trees judge each by features of its form and of the words around
it, and thresholds calibrated for each kind select what is added.  Of added spans
that overlap, the one with the best score stays; none overlaps a base span.

Training needs no labels.  From a bounded sample of documents (``SAMPLE`` different
rows by hash, ``SAMPLE_BYTES`` in all; whole texts) positives are base spans rewritten in the loose forms people
use ((at), dot, spaced or missing marks) and generated secrets of 16 to 1448
characters, each set in its own or another document's words; negatives are the
generators' finds that touch no base span, and numbers of other kinds (versions,
dates, prices, counters, paths) set in such words.  A fifth is held back; each kind's threshold is the smallest score
that keeps ``PRECISION`` there.

Defined cases: null text counts as empty and has no spans; positions are code
points, end exclusive; every pattern runs in time linear in the text, also over
very long runs of word characters or digits; an empty table trains on generated
cases alone and gives no rows; further columns are ignored.  ``n_email`` to ``n_phone``
count base spans, ``n_spans`` all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, within_bytes

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SAMPLE = 3000
SAMPLE_BYTES = 48 << 20
PRECISION = 0.98
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at  # a local part cannot reach back over this mark, so no character is read twice
        at = text.find("@", at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    if not text or not _ANY.search(text):
        return []
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- generators

_AT = r"\s?(?:@|\(at\)|\[at\]|\bat\b|\(a\))\s?"
_DOT = r"\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?"
_GENERATORS = {
    "email": re.compile(rf"(?<![\w.%+-])[\w.%+-]++{_AT}[\w-]++(?:{_DOT}[\w-]{{2,}}+)++", re.I),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\s?[.,]\s?|\s?(?:\[\.\]|\(dot\)|\[dot\])\s?)\d{1,3}(?:(?:\s?[.,]\s?|\s?(?:\[\.\]|\(dot\)|\[dot\])\s?)\d{1,3}){1,2}(?![\d])"),
    "card": re.compile(r"(?<!\d)\d{3,6}+(?:[ ._/-]?\d{2,6}+){2,5}(?!\d)"),
    "phone": re.compile(r"(?<![\w])(?:\+|00)?\(?\d{1,4}\)?(?:[ ./-]{0,2}\(?\d{2,5}\)?){1,5}(?!\w)"),
    "secret": re.compile(r"(?<![\w+/=-])[A-Za-z0-9_+/-]{12,}+(?:\.[A-Za-z0-9_+/-]{12,}+)*+=*"),
}
#: What every match of a generator holds: a digit, a mark that stands for @, or (in lower case) the word "at" before a dotted word.
_MARK = re.compile(r"[\d@]")
_AT_WORD = re.compile(rf"at\b(?<=\bat)\s?[\w-]++{_DOT}[\w-]{{2}}")
_DIGIT = re.compile(r"[0-9]")
_CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "addr", "server"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "mobil", "fax"),
    "secret": ("token", "passw", "secret", "key", "auth", "akia", "="),
}
_OTHER = ("version", "page", "isbn", "no.", "vol", "license", "chapter", "figure", "$", "%", "©")


def proposals(text: str) -> list[Span]:
    """Every match of every generator; a secret holds a digit."""
    return [(kind, m.start(), m.end()) for kind, g in _GENERATORS.items() for m in g.finditer(text) if kind != "secret" or _DIGIT.search(text, *m.span())]


def may_propose(text: str) -> bool:
    """False only if no generator can match; literals first, because most texts hold nothing."""
    if _MARK.search(text):
        return True
    low = text.lower()
    return "(at)" in low or "[at]" in low or "(a)" in low or _AT_WORD.search(low) is not None


def candidates(text: str | None) -> list[Span]:
    """What the generators propose; spans of different kinds may overlap."""
    return proposals(text) if text and may_propose(text) else []


def features(text: str, span: Span) -> list[float]:
    """Form of the span and what stands around it."""
    kind, a, b = span
    s = text[a:b]
    d = _digits(s)
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    parts = [int(x) for x in re.findall(r"\d{1,9}", s)][:6]
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    runs = re.findall(r"\d+|[^\W\d_]+|[\W_]+", s)
    counts = np.unique(list(s), return_counts=True)[1] / len(s)
    tail = re.match(r"\W*+([a-z]+)", s.lower()[::-1])  # from the end, so that a long run is read once
    return [
        float(ALL_KINDS.index(kind)),
        float(len(s)),
        float(len(d)),
        letters / len(s),
        upper / max(1, letters),
        float(len(runs)),
        float(max((len(r) for r in runs), default=0)),
        float(-(counts * np.log2(counts)).sum()),
        float(luhn(d)) if len(d) >= 12 else -1.0,
        float(len(parts)),
        float(max(parts, default=0)),
        float(min((len(r) for r in runs if r.isdigit()), default=0)),
        float(len(tail[1]) if tail else 0),
        float("@" in s or "(at)" in s.lower() or "[at]" in s.lower()),
        float(s.count(".") + s.lower().count("dot")),
        float(bool(re.match(r"\+|00|\(", s))),
        float(s.count(" ")),
        float(s.count("-") + s.count("/")),
        float(any(c in before for c in _CUES[kind])),
        float(any(c in before for c in _OTHER)),
        float(before[-1:] in "=:\"'"),
        float(after[:1].isalnum()),
        float(bool(re.search(r"\d\W*$", before))),
        float(bool(re.match(r"\W*\d", after))),
        float(bool(re.search(r"[A-Z]{4}", s))),
    ]


# ---------------------------------------------------------------- boosted trees


class BoostedTrees:
    """Logistic gradient boosting over binned features: depth-wise trees stored as arrays."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prior = 0.0

    def fit(self, X: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(X.shape[1])]
        B = np.stack([np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(edges)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.prior)
        width = self.bins + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feat, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), np.int64)
            for n in range(size):
                own = np.flatnonzero(node == n)
                if not len(own):
                    continue
                G, H = g[own].sum(), h[own].sum()
                value[n] = self.rate * G / (H + self.l2)
                if n >= 2**self.depth - 1 or len(own) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = np.bincount(B[own, j], minlength=width).cumsum()[: len(e)]
                    gl = np.bincount(B[own, j], g[own], width).cumsum()[: len(e)]
                    hl = np.bincount(B[own, j], h[own], width).cumsum()[: len(e)]
                    gain = gl**2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G**2 / (H + self.l2)
                    gain[(c < self.least) | (len(own) - c < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feat[n], cut[n] = best[1], edges[best[1]][best[2]]
                    node[own] = np.where(X[own, best[1]] <= cut[n], 2 * n + 1, 2 * n + 2)
            self.trees.append((feat, cut, value))
            z += value[node]
        return self

    def score(self, X: np.ndarray) -> np.ndarray:
        z = np.full(len(X), self.prior)
        for feat, cut, value in self.trees:
            node = np.zeros(len(X), np.int64)
            for _ in range(self.depth):
                f = feat[node]
                left = X[np.arange(len(X)), np.maximum(f, 0)] <= cut[node]
                node = np.where(f < 0, node, np.where(left, 2 * node + 1, 2 * node + 2))
            z += value[node]
        return 1 / (1 + np.exp(-z))


# ---------------------------------------------------------------- training


def _loose(rng: np.random.Generator, kind: str, s: str) -> str:
    """A base span as people write it when they avoid, or forget, its strict form."""
    pick = rng.integers(4)
    if kind == "email":
        at = (" (at) ", "(at)", " [at] ", " at ")[pick]
        dot = (".", " dot ", " (dot) ", " [dot] ")[rng.integers(4)]
        name, _, host = s.partition("@")
        return name + at + (host.replace(".", dot) if at != " at " else host)
    if kind == "ip":
        return s.replace(".", ("[.]", " . ", "(dot)", " [.] ")[pick])
    d = _digits(s)
    if kind == "card":
        sep = (".", "_", "/", " . ")[pick][:1]
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    local = d[-10:] if len(d) >= 10 else d
    area, rest = local[:3], local[3:]
    return (f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"00{d[:-10] or 1} {area} {rest[:3]} {rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}")[pick]


def _generated(rng: np.random.Generator, kind: str, *, long: bool = False) -> str:
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(4, 10)))
    if kind == "email":
        return f"{word()}.{num(2)}@{word()}.{('com', 'org', 'net')[rng.integers(3)]}"
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(1, 255, 4))
    if kind == "card":
        d = "4" + num(14)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))
    if kind == "phone":
        return f"+{rng.integers(1, 99)} {num(3)} {num(3)} {num(4)}"
    sets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    chars = sets[rng.integers(3)]
    n = rng.integers(16, 49)
    if long:  # signatures, payloads and keys on one line
        chars, n = (*sets, sets[2] + "-_", sets[2] + "+/")[rng.integers(5)], int(2 ** rng.uniform(5.5, 10.5))
        if chars == sets[2] + "-_" and rng.random() < 0.7:  # signed tokens: header, content and signature
            return ".".join("".join(chars[i] for i in rng.integers(0, len(chars), k)) for k in (rng.integers(18, 60), max(12, n // 2), rng.integers(22, 90)))
    return "".join(chars[i] for i in rng.integers(0, len(chars), n))


def _path(rng: np.random.Generator) -> str:
    """Words and numbers joined as in paths and titles of pages, up to the length of long secrets."""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 11)))
    sep = "-_/"[rng.integers(3)]
    return sep.join([str(rng.integers(1, 3000)), *(str(rng.integers(1, 3000)) if rng.random() < 0.2 else word() for _ in range(int(2 ** rng.uniform(1, 8))))])


def _harmless(rng: np.random.Generator) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    return (
        f"{n(1, 12)}.{n(0, 20)}.{n(0, 20)}",
        f"version {n(1, 9)}.{n(0, 9)}",
        f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}",
        f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2100)}",
        f"{n(1, 999)},{n(0, 1000):03d},{n(0, 1000):03d}",
        f"{n(1, 99999)}.{n(0, 100):02d}",
        f"pp. {n(1, 500)}-{n(500, 999)}",
        f"{n(0, 24)}:{n(0, 60):02d}",
        f"{n(1, 10**6)}",
        f"chapter-{n(1, 99)}-section-{n(1, 99)}",
        f"item_{n(1, 10**6)}_of_list",
        f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}",
        f"meet at noon. {n(1, 10)}",
        _path(rng),
    )[n(0, 14)]


@dataclass
class PiiModel:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that touch no base span and no better candidate."""
        taken = [(a, b) for _, a, b in base]
        found = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in _near(taken, c))]
        if not found:
            return []
        p = self.trees.score(np.array([features(text, c) for c in found]))
        good = sorted((-x, c[1], c[2], c[0]) for x, c in zip(p.tolist(), found, strict=True) if x >= self.thresholds[c[0]])
        out: list[Span] = []
        kept = _Intervals()
        for _, a, b, kind in good:
            if kept.add(a, b):
                out.append((kind, a, b))
        return out


class _Intervals:
    """Disjoint intervals, kept sorted."""

    def __init__(self):
        self.at: list[tuple[int, int]] = []

    def add(self, a: int, b: int) -> bool:
        from bisect import bisect_left

        i = bisect_left(self.at, (a, b))
        if i and self.at[i - 1][1] > a or i < len(self.at) and self.at[i][0] < b:
            return False
        self.at.insert(i, (a, b))
        return True


def _near(taken: list[tuple[int, int]], span: Span) -> list[tuple[int, int]]:
    return taken if len(taken) < 64 else [x for x in taken if x[0] < span[2] and span[1] < x[1]]


def train(texts: list[str], *, per_kind: int = 400, seed: int = 11) -> PiiModel:
    rng = np.random.default_rng(seed)
    X, y, kinds = [], [], []

    def put(text: str, span: Span, label: int) -> None:
        X.append(features(text, span))
        y.append(label)
        kinds.append(span[0])

    pool = [t for t in texts if t and len(t) > 60] or ["and the of to in it is that for as " * 4]

    def set_in(piece: str, cue: str) -> tuple[str, int]:
        t = pool[rng.integers(len(pool))]
        at = t.find(" ", int(rng.integers(0, max(1, len(t) - 40)))) + 1
        left, right = t[max(0, at - 40) : at], t[at : at + 40]
        left = left + cue
        return f"{left}{piece} {right}", len(left)

    seeds: dict[str, list[str]] = {k: [] for k in ALL_KINDS}
    for t in texts:
        base = base_spans(t)
        for kind, a, b in base:
            if len(seeds[kind]) < per_kind:
                seeds[kind].append(t[a:b])
        free = [c for c in candidates(t) if c[0] != "secret" and not any(a < c[2] and c[1] < b for _, a, b in base)]
        for c in free[:4]:  # the sample's other numbers, a few of each document
            put(t, c, 0)
    for kind in ALL_KINDS:
        for i in range(per_kind + (kind == "secret") * (per_kind // 3)):
            own = seeds[kind]
            strict = own[rng.integers(len(own))] if own and i % 2 else _generated(rng, kind, long=i >= per_kind)
            piece = strict if kind == "secret" else _loose(rng, kind, strict)
            cue = _CUES[kind][rng.integers(len(_CUES[kind]))] + (" ", ": ", "=", ' = "')[rng.integers(4)] if rng.random() < 0.5 else ""
            text, at = set_in(piece, cue)
            for c in candidates(text):
                if c[1] < at + len(piece) and at < c[2]:
                    whole = abs(c[1] - at) <= 2 and abs(c[2] - at - len(piece)) <= 2
                    if c[0] == kind and whole:
                        put(text, c, 1)
                    elif not whole:
                        put(text, c, 0)
            text, at = set_in(_harmless(rng), "")
            for c in candidates(text):
                put(text, c, 0)
    X, y, kinds = np.array(X), np.array(y, float), np.array(kinds)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    trees = BoostedTrees().fit(X[fit], y[fit])
    p = trees.score(X[held])
    thresholds = {}
    for kind in ALL_KINDS:
        own = kinds[held] == kind
        s, l = p[own], y[held][own]
        best = 0.99
        for cut in sorted({round(float(x), 6) for x in s if x >= 0.5}):
            kept = s >= cut
            if l[kept].mean() >= PRECISION:
                best = cut
                break
        thresholds[kind] = max(0.5, best)
    return PiiModel(trees, thresholds)


def learn(docs: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 11) -> PiiModel:
    """Train on ``sample`` different rows (doc_id, text), chosen by hash, of at most ``sample_bytes`` in all (what would exceed that is passed over)."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = rows.select("h", F.octet_length("text").alias("n")).groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(sample).collect()
    keep = within_bytes([(r.h, r.n) for r in drawn], sample_bytes)
    ids = docs.sparkSession.createDataFrame([(h,) for h in sorted(keep)], "h long")
    got = rows.join(F.broadcast(ids), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).collect()  # equal rows once
    return train([r.text for r in sorted(got, key=lambda r: r.h)], seed=seed)


def spans(text: str | None, model: PiiModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind as listed and start."""
    text = text or ""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(ALL_KINDS)}
    return base, sorted(base + model.added(text, base), key=lambda s: (order[s[0]], s[1], s[2]))


def redacted(text: str | None, found: list[Span]) -> str | None:
    """The text with every run of overlapping spans replaced by its first span's kind."""
    if not text or not found:
        return text
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _code(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, every, total = [], [], [], []
            for t in b.column(1).to_pylist():
                base, found = spans(t, shared.value)
                n.append([sum(s[0] == k for s in base) for k in KINDS])
                sha.append(hashlib.sha256(_code(base).encode()).hexdigest())
                every.append(_code(found))
                total.append(len(found))
            counts = np.array(n, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(len(KINDS))), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(total, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with redacted texts (and ``n_chars``, where the column exists, counted anew)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(t, spans(t, shared.value)[1]) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(run, T.StructType(list(docs.schema.fields)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def op7_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
