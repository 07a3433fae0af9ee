"""Personal data in texts: patterns that hold by themselves, and doubtful ones decided by learned votes.

Base spans are strict matches and always stay. Looser patterns give further candidates; regular
expressions, gazetteers and the words around vote on each, for, against or not at all.
Expectation-maximisation estimates from the vote patterns of the whole table how reliable
each labeler is, and its posteriors train a logistic span classifier, whose input also has
the candidate's shape. Candidates it accepts are added where they touch no span of their kind.

What is gathered is one count per kind, vote pattern and shape: a few thousand numbers,
whatever the input.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import text as T

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "context", "border")
ROUNDS = 50
Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"}
_CARD_STARTS = ("34", "37", "30", "36", "38", "4", "51", "52", "53", "54", "55", "6")
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|amex|mastercard|credit|debit|pay\w*)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|isbn|order|invoice|serial|part|model|no|nr|sku)\b\W*$", re.I)
_AROUND = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From at sign to at sign, so that no stretch is read twice."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        run = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if run else None
        if found:
            yield at - run, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def _valid_ip(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _valid_card(s: str) -> bool:
    digits = _digits(s)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Matches of the strict patterns, and whether they pass their check."""
    for a, b in _emails(text):
        yield "email", a, b, True
    for m in _IP.finditer(text):
        yield "ip", *m.span(), _valid_ip(m[0])
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            yield "card", *m.span(), _valid_card(m[0])
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 8 <= len(_digits(m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    """Strict matches in order of kind and place: leftmost, not overlapping, checks passed."""
    return [(kind, a, b) for kind, a, b, good in _matches(text) if good]


def _check(kind: str, s: str) -> int:
    digits = _digits(s)
    if kind == "email":
        return 1 if re.search(r"[a-z0-9]", s) else -1
    if kind == "ip":
        return 1 if "::" not in s and (":" in s or _valid_ip(s)) else -1
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    return 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else -1


def _gazetteer(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[. )\]]+", s)[-1].lower() in _TOP_DOMAINS else -1
    if kind == "card":
        return 1 if _digits(s).startswith(_CARD_STARTS) else -1
    if kind == "phone":
        return -1 if _digits(s)[:3] in ("000", "123") else 0
    return -1 if s.startswith(("0.", "127.")) else 0


def votes(text: str, kind: str, a: int, b: int, form: int) -> tuple[int, ...]:
    """What each labeler says of a span: 1, -1 or 0."""
    s, before, after = text[a:b], text[max(0, a - _AROUND) : a], text[b : b + _AROUND]
    context = -1 if _AGAINST.search(before) else 1 if _CUES[kind].search(before) or _CUES[kind].search(after) else 0
    border = -1 if before[-1:].isalnum() or after[:1].isalnum() else 1
    return form, _check(kind, s), _gazetteer(kind, s), context, border


def _shape(s: str) -> int:
    """Length in fours up to seven, and whether digits, letters and spaces occur."""
    return min(7, len(s) // 4) * 8 + 4 * bool(re.search(r"[0-9]", s)) + 2 * bool(re.search(r"[A-Za-z]", s)) + (" " in s)


@dataclass
class Candidates:
    base: list[Span] = field(default_factory=list)
    spans: list[Span] = field(default_factory=list)
    patterns: list[tuple[str, tuple[int, ...], int]] = field(default_factory=list)


def candidates(text: str) -> Candidates:
    """Base spans, and every candidate with its votes and shape (base spans are candidates too)."""
    out = Candidates()
    found: list[tuple[str, int, int, int]] = []
    for kind, a, b, good in _matches(text):
        found.append((kind, a, b, 1 if good else -1))
        if good:
            out.base.append((kind, a, b))
    for kind, pattern in _LOOSE.items():
        if kind != "email" or "(" in text or "[" in text:
            found += [(kind, *m.span(), 0) for m in pattern.finditer(text)]
    for kind, a, b, form in found:
        out.spans.append((kind, a, b))
        out.patterns.append((kind, votes(text, kind, a, b, form), _shape(text[a:b])))
    return out


@dataclass
class Classifier:
    """Weights by kind: a constant, one for each vote, and one for each shape seen."""

    weights: dict[str, np.ndarray]
    shapes: dict[tuple[str, int], float]
    reliability: dict[str, np.ndarray]

    def accepts(self, kind: str, vote: tuple[int, ...], shape: int) -> bool:
        w = self.weights[kind]
        return w[0] + float(np.dot(w[1:], vote)) + self.shapes.get((kind, shape), 0.0) > 0


def expectation_maximisation(vote: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and of each labeler the chance to be right where it votes.

    Starts from a majority vote; counts of one half keep every estimate inside (0, 1).
    """
    posterior = 1 / (1 + np.exp(-vote.sum(1).astype(float)))
    right = np.full(vote.shape[1], 0.5)
    for _ in range(rounds):
        share = (np.dot(count, posterior) + 0.5) / (count.sum() + 1)
        cast = vote != 0
        agrees = np.where(vote > 0, posterior[:, None], 1 - posterior[:, None])
        right = ((count[:, None] * cast * agrees).sum(0) + 2) / ((count[:, None] * cast).sum(0) + 3)
        odds = np.log(share / (1 - share)) + vote @ np.log(right / (1 - right))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, right


def fit(counts: list[tuple[str, tuple[int, ...], int, int]]) -> Classifier:
    """A span classifier from counted patterns ``(kind, votes, shape, count)``.

    A kind without candidates goes by majority.
    """
    weights, shapes, reliability = {}, {}, {}
    for kind in KINDS:
        own = sorted(c for c in counts if c[0] == kind)
        weights[kind] = np.array([-0.5, *[1.0] * len(LABELERS)])
        reliability[kind] = np.full(len(LABELERS), 0.5)
        if not own:
            continue
        vote, count = np.array([c[1] for c in own]), np.array([c[3] for c in own], float)
        posterior, reliability[kind] = expectation_maximisation(vote, count)
        seen = sorted({c[2] for c in own})
        x = np.hstack([np.ones((len(own), 1)), vote, np.array([[c[2] == s for s in seen] for c in own], float)])
        size = count / count.sum()
        w = np.zeros(x.shape[1])
        keep = 1e-3 * np.eye(len(w))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (size * (posterior - p)) - keep @ w
            curve = (x * (size * p * (1 - p))[:, None]).T @ x + keep
            w += np.clip(np.linalg.solve(curve, slope), -2, 2)
        weights[kind] = w[: 1 + len(LABELERS)]
        shapes |= {(kind, s): float(v) for s, v in zip(seen, w[1 + len(LABELERS) :], strict=True)}
    return Classifier(weights, shapes, reliability)


def _suspects(texts: pa.Array) -> np.ndarray:
    """Rows whose text has a digit, an at sign or a colon, or an address spelled in brackets."""
    raw, borders = T.utf8(texts)
    mark = np.zeros(256, bool)
    mark[[*range(48, 58), ord("@"), ord("["), ord("("), ord(":")]] = True
    hits = np.concatenate(([0], np.cumsum(mark[raw])))
    return hits[borders[1:]] > hits[borders[:-1]]


def _found(column: pa.Array) -> Iterator[tuple[int, str, Candidates]]:
    for low, high in T.slices(column):
        part = column.slice(low, high - low)
        for i, (text, look) in enumerate(zip(part.to_pylist(), _suspects(part).tolist(), strict=True)):
            yield low + i, text or "", candidates(text) if look else Candidates()


def _patterns(batches):
    for batch in batches:
        counts: dict[tuple, int] = {}
        for _, _, found in _found(batch.column(0)):
            for pattern in found.patterns:
                counts[pattern] = counts.get(pattern, 0) + 1
        if counts:
            kinds, vote, shape = zip(*counts, strict=True)
            packed = [",".join(map(str, v)) for v in vote]
            columns = [pa.array(kinds, pa.string()), pa.array(packed, pa.string()), pa.array(shape, pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "votes", "shape", "n"])


def learn(docs: DataFrame, text_col: str = "text") -> Classifier:
    """The classifier that the candidates of all ``docs`` give."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_patterns, "kind string, votes string, shape int, n long")
    rows = counted.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    return fit([(r.kind, tuple(map(int, r.votes.split(","))), r.shape, r.n) for r in rows])


def all_spans(found: Candidates, model: Classifier) -> list[Span]:
    """Base spans and accepted candidates that touch none of their kind, by kind and place.

    A strict match that failed its check is dropped for good; looser candidates inside it may pass.
    """
    # Spans of a kind don't overlap, so only those next to a candidate's place can touch it.
    starts: dict[str, list[int]] = {kind: [] for kind in KINDS}
    ends: dict[str, list[int]] = {kind: [] for kind in KINDS}
    for kind, a, b in sorted(found.base, key=lambda s: s[1]):
        starts[kind].append(a)
        ends[kind].append(b)
    for (kind, a, b), (_, vote, shape) in zip(found.spans, found.patterns, strict=True):
        at = bisect_left(starts[kind], a)
        touches = (at > 0 and ends[kind][at - 1] > a) or (at < len(starts[kind]) and starts[kind][at] < b)
        if vote[0] >= 0 and not touches and model.accepts(kind, vote, shape):
            starts[kind].insert(at, a)
            ends[kind].insert(at, b)
    return [(kind, a, b) for kind in KINDS for a, b in zip(starts[kind], ends[kind], strict=True)]


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are those of the base spans, ``spans`` lists all as ``kind:start:end`` in
    code points. A null text is empty and has none. The digest of no span is that of the
    empty string.
    """
    model = model or learn(docs, text_col)

    def mark(batches):
        for batch in batches:
            base, every = [], []
            for _, _, found in _found(batch.column(1)):
                base.append(found.base)
                every.append(_text_of(all_spans(found, model)))
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(_text_of(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(every, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(mark, kinds)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; of overlapping spans, the first and longest."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, model: Classifier | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked in the text, and its length set anew where there is such a column.

    Null texts stay null.
    """
    model = model or learn(docs, text_col)
    at = docs.columns.index(text_col)

    def rewrite(batches):
        for batch in batches:
            texts = batch.column(at)
            new = [None if not ok else masked(text, all_spans(found, model)) if found.spans else text for (_, text, found), ok in zip(_found(texts), texts.is_valid().to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(rewrite, docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast(docs.schema[length_col].dataType))
    return out
