"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Base spans are fixed patterns with validators and always stay. Wider generators propose
further spans, such as addresses with [at] or phones without a +, whose plain form a base
pattern and its validator accept. Boosted trees score the plain form and the context,
trained on candidates that the base patterns or key words nearby confirm; a calibrated
threshold picks those added. The way a span is written is no feature: it would tell base
spans from all others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, unkeyed

# The base patterns, in the order in which kinds are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = (*BASE, "secret")
# The generators, wider than the base patterns, and words that speak for a kind.
WIDE = {
    "email": re.compile(r"[\w.%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[\w-]{1,64}(?: ?(?:\.|\[dot\]|\(dot\)) ?[\w-]{1,64}){1,4}"),
    "ip": re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]) ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .\-]?[0-9]){12,18}"),
    "phone": re.compile(r"[+(]?[0-9][ ().0-9/-]{6,18}[0-9]"),
    "secret": re.compile(r"[A-Za-z0-9+/_=-]{20,200}"),
}
HINTS = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "bearer"),
}


@dataclass(frozen=True)
class PiiOptions:
    """The trees are fitted on the candidates of at most `sample` documents (those with the
    smallest hash of their id among documents with a digit or an @). A threshold lies below
    the lowest score from which `precision` of the held-out candidates are confirmed."""

    sample: int = 4_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    precision: float = 0.97


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = re.sub(r"[^0-9]", "", found) if kind in ("card", "phone") else ""
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches per kind that their validator accepts; a failing match is passed over."""
    out = []
    for kind in BASE:
        out += [(kind, a, b) for a, b in _matches(kind, text) if _valid(kind, text[a:b])]
    return out


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """What `BASE[kind].finditer` finds, in time that grows with the text alone.

    A run of digits that does not begin an address fails from each of its digits, and a run
    of letters that no @ follows from each letter; both are passed over at once.
    """
    if kind == "email":
        yield from _emails(text)
    elif kind != "phone" or "+" in text:
        yield from (m.span() for m in (_ADDRESS if kind == "ip" else BASE[kind]).finditer(text))


_ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the next match may start
    while (at := text.find("@", free)) >= 0:
        start = at
        while start > free and text[start - 1] in _NAME_SIGNS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1


_DIGIT = re.compile(r"[0-9]")


# What other ways of writing become in the plain form. A bare sign needs a space on both sides.
PLAIN = {
    "email": ((re.compile(r" ?(?:\[at\]|\(at\)) ?| @ "), "@"), (re.compile(r" ?(?:\[dot\]|\(dot\)) ?| \. "), ".")),
    "ip": ((re.compile(r" ?\[\.\] ?| \. "), "."),),
    "card": ((re.compile(r"[ .\-]"), ""),),
    "phone": ((re.compile(r"^\+?\(?"), "+"), (re.compile(r"/"), "-")),
}


def plain(kind: str, span: str) -> str | None:
    """`span` as a base pattern has it, None if its validator does not accept that."""
    for pattern, sign in PLAIN[kind]:
        span = pattern.sub(sign, span)
    return span if BASE[kind].fullmatch(span) and _valid(kind, span) else None


def local_forms(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """A base phone as it is written within its country, in its context: (text, start, end)."""
    local = re.sub(r"^\+[0-9]{1,3}[ .-]*", "", text[start:end])
    digits = re.findall(r"[0-9]+", local)
    for form in dict.fromkeys((local, "-".join(digits), ".".join(digits), " ".join(digits))):
        if len(digits) > 1 and plain("phone", form):
            yield text[:start] + form + text[end:], start, start + len(form)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans the generators propose and, in plain form, the validators accept."""
    out = []
    has_digit, has_at = _DIGIT.search(text) is not None, "@" in text or "at]" in text or "at)" in text
    for kind, pattern in WIDE.items():
        if has_at if kind == "email" else has_digit:
            for m in pattern.finditer(text):
                if _DIGIT.search(m.group()) if kind == "secret" else plain(kind, m.group()):
                    out.append((kind, m.start(), m.end()))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format (of the plain form) and context. What makes the labels is not among them:
    validators, and for all kinds but secrets the key words."""
    span, before = text[start:end], text[max(0, start - 24) : start].lower()
    if kind != "secret":
        span = plain(kind, span) or span
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    groups = re.findall(r"[0-9]+", span)
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(digits),
        digits / len(span),
        letters / len(span),
        hexes / len(span),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(set(span))) / len(span),
        float(span[0] in "+("),
        float("@" in span),
        float(span.count(".")),
        float(kind == "secret" and any(h in before for h in HINTS[kind])),
        float(before[-1:].isalnum()),
        float(text[end : end + 1].isalnum()),
        float(before[-1:] in "\"'=:"),
    ]


def _confirmed(text: str, kind: str, start: int, end: int, base: set[tuple[str, int, int]]) -> bool:
    if kind == "secret":
        return any(h in text[max(0, start - 24) : start].lower() for h in HINTS[kind]) and text[start - 1 : start] in ("\"", "'", "=", ":", " ")
    return (kind, start, end) in base or any(h in text[max(0, start - 24) : start].lower() for h in HINTS[kind])


def _other(kind: str, start: int, end: int, base: set[tuple[str, int, int]]) -> bool:
    """Whether a base span of another kind has a part of it; never true of a base span."""
    return (kind, start, end) not in base and any(k != kind and s < end and start < e for k, s, e in base)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of fixed depth over binned features, with a threshold per kind."""

    edges: list = field(default_factory=list)
    nodes: list = field(default_factory=list)  # per tree: features, bins, leaf values
    start: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; rows of features in, one number each out."""
        total = np.full(len(x), self.start)
        if self.nodes and len(x):
            b, rows = self.binned(x), np.arange(len(x))
            for split, bins, leaves in self.nodes:
                at = np.zeros(len(x), dtype=np.int64)
                while at[0] < len(split):
                    at = 2 * at + 1 + (b[rows, split[at]] > bins[at])
                total += leaves[at - len(split)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, options: PiiOptions) -> Trees:
    """Logistic loss, Newton leaves, histogram splits."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, options.bins)[1:-1])) for f in range(x.shape[1])]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(edges, [], float(np.log(rate / (1 - rate))))
    b, total = trees.binned(x), np.full(len(x), trees.start)
    inner = 2**options.depth - 1
    for _ in range(options.trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        split, bins, at = np.zeros(inner, dtype=np.int64), np.full(inner, options.bins, dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-9
            for f in range(x.shape[1]) if len(mine) else ():
                sums = [np.bincount(b[mine, f], weights=v[mine], minlength=options.bins + 1).cumsum() for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (sums[0][-1], sums[1][-1])
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                if gain.max() > best:
                    best, split[node], bins[node] = gain.max(), f, int(gain.argmax())
            at[mine] = 2 * node + 1 + (b[mine, split[node]] > bins[node])
        leaf = at - inner
        sums = [np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h)]
        values = options.rate * sums[0] / (sums[1] + 1)
        trees.nodes.append((split, bins, values))
        total += values[leaf]
    return trees


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray, options: PiiOptions) -> Trees:
    """Per kind the lowest score from which on the share confirmed is the precision asked for,
    half-way to the next lower one, but no less than even odds."""
    score, out = trees.score(x), {}
    for k, kind in enumerate(KINDS):
        mine = np.flatnonzero(x[:, 0] == k)
        order = mine[np.argsort(-score[mine], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        last = np.append(np.diff(score[order]) < 0, True)[: len(order)]  # of equal scores
        good = np.flatnonzero((right >= options.precision) & last)
        below = [*score[order], 0.0]
        out[kind] = max(0.5, float(below[good[-1]] + below[good[-1] + 1]) / 2) if len(good) else 2.0
    return Trees(trees.edges, trees.nodes, trees.start, out)


def train(docs: DataFrame, options: PiiOptions = PiiOptions()) -> Trees:
    """Trees and thresholds from the candidates of a bounded sample of documents, and from its
    base phones in local forms. Without a candidate nothing is ever added."""
    sample = keyed(docs).where(F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64("key"), "key").limit(options.sample)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for text in batch.column("text").to_pylist():
                base = set(base_spans(text))
                for kind, start, end in candidates(text):
                    # Another cut of a base span of its kind says nothing about the kind.
                    if (kind, start, end) not in base and any(k == kind and s < end and start < e for k, s, e in base):
                        continue
                    rows.append(features(text, kind, start, end))
                    labels.append(_confirmed(text, kind, start, end, base) and not _other(kind, start, end, base))
                for _, start, end in (x for x in base if x[0] == "phone"):
                    forms = [features(t, "phone", s, e) for t, s, e in local_forms(text, start, end)]
                    rows += forms
                    labels += [True] * len(forms)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.bool_())], names=["x", "y"])

    found = sample.mapInArrow(gather, "x array<double>, y boolean").toArrow()
    x, y = np.array(found.column("x").to_pylist()), np.array(found.column("y").to_pylist(), dtype=float)
    if len(y) < 10 or y.min() == y.max():
        return Trees(thresholds=dict.fromkeys(KINDS, 2.0))
    order = np.lexsort(x.T)
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 4 == 0
    return calibrate(fit(x[~held], y[~held], options), x[held], y[held], options)


def all_spans(texts: list[str], trees: Trees) -> Iterator[tuple[list, list]]:
    """(base spans, base and added spans) for each text. An added span overlaps no other of its kind."""
    base = [base_spans(t) for t in texts]
    proposed = [(d, c) for d, t in enumerate(texts) for c in candidates(t)]
    taken = {(d, k): [(s, e) for kk, s, e in spans if kk == k] for d, spans in enumerate(base) for k in {k for k, _, _ in spans}}
    fresh = [
        (d, c) for d, c in proposed if not any(s < c[2] and c[1] < e for k in KINDS for s, e in taken.get((d, k), ()))
    ]
    added: list[list] = [[] for _ in texts]
    if fresh:
        score = trees.score(np.array([features(texts[d], *c) for d, c in fresh]))
        for i in np.argsort(-score, kind="stable"):
            d, (kind, start, end) = fresh[i]
            spans = taken.setdefault((d, kind), [])
            if score[i] >= trees.thresholds[kind] and not any(s < end and start < e for s, e in spans):
                spans.append((start, end))
                added[d].append((kind, start, end))
    place = {k: i for i, k in enumerate(KINDS)}
    for mine, more in zip(base, added, strict=True):
        yield mine, sorted(mine + more, key=lambda s: (place[s[0]], s[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    NULL and empty texts have no span. Rows repeating an id are searched one by one. Offsets
    count code points. An empty table gives no row.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, (base, spans) in zip(batch.column("key").to_pylist(), all_spans(batch.column("text").to_pylist(), trees), strict=True):
                counts = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE}
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                out.append({"key": key} | counts | {"base_sha256": digest, "spans": _joined(spans)})
            yield pa.RecordBatch.from_pylist(out, schema)

    counts = [f"n_{k}" for k in BASE]
    schema = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string())])
    kind = ", ".join(f"{c} long" for c in ("key", *counts)) + ", base_sha256 string, spans string"
    return keyed(docs).mapInArrow(search, kind).select(unkeyed("key", "doc_id"), *counts, "base_sha256", "spans")
