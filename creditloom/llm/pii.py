"""Personal data by weak supervision.

Base rules find emails, addresses, cards and phones. Wider rules propose more spans: phones that the
base rule lost to a neighbour, and secrets. Five labelers (form, gazetteer, context, boundary, check)
vote yes or no on every proposed span or abstain. Expectation maximisation over the counts of all
vote patterns in the corpus estimates how reliable each labeler is, and with that how likely each
pattern is a hit; a logistic classifier of a span's form and surroundings learns these likelihoods
and decides. Patterns and forms are few whatever the corpus, so only their counts leave Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4
#: Kinds that are about a person; a secret is reported, but a text that has no more is left alone.
PERSONAL = (EMAIL, IP, CARD, PHONE)
ABSTAIN, NO, YES = range(3)
LABELERS = 5

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starts at the start of a run of digits, as the leftmost match does, and never gives digits back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = b"0123456789"

_GROUPED_PHONE = re.compile(r"\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_COUNTRY = re.compile(r"\+[0-9]{1,3} ?$")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{16,}(?![0-9A-Za-z])")
_KEYED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?([^\s\"',;]{6,})")
_SECRET_HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "glpat-")
_HEADED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|ghp_|gho_|xoxb-|xoxp-|sk-|glpat-)[A-Za-z0-9_-]{12,}")
_TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu co us".split())
_COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 44 45 46 47 48 49 52 55 61 81 82 86 90 91".split())
_CUES = {
    EMAIL: ("mail", "contact", "write"),
    IP: ("host", "server", "address", "ip "),
    CARD: ("card", "visa", "credit", "payment"),
    PHONE: ("call", "phone", "tel", "mobile", "fax"),
    SECRET: ("=", ":", "key", "token", "pass", "secret"),
}

Span = tuple[int, int, int]
Candidate = tuple[int, int, int, int, int, bool]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    """Of a number of any length, leading zeros included."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_spans(text: str, raw: bytes) -> list[Span]:
    """(kind, start, end) of the base rules: leftmost, non-overlapping per kind, failing ones dropped."""
    found: list[Span] = []
    done = 0
    for m in _AT.finditer(text) if b"@" in raw else ():
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((EMAIL, start, m.end()))
            done = m.end()
    if len(raw.translate(None, _DIGITS)) == len(raw):
        return found
    for m in _IP.finditer(text) if b"." in raw else ():
        if all(at_most_255(part) for part in m.group().split(".")):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text) if b"+" in raw else ():
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


def _proposed(text: str, raw: bytes) -> list[Span]:
    """Spans beyond the base rules that the labelers are asked about."""
    found: list[Span] = []
    if b"(" in raw:
        for m in _GROUPED_PHONE.finditer(text):
            head = _COUNTRY.search(text, max(0, m.start() - 6), m.start())
            found.append((PHONE, head.start() if head else m.start(), m.end()))
    secrets: list[tuple[int, int]] = []
    if len(raw.translate(None, _DIGITS)) != len(raw):
        secrets += [m.span() for m in _HEX.finditer(text)]
    if b"=" in raw or b":" in raw:
        secrets += [m.span(1) for m in _KEYED.finditer(text)]
    if any(head in text for head in _SECRET_HEADS):
        secrets += [m.span() for m in _HEADED.finditer(text)]
    end = -1
    for start, stop in sorted(secrets, key=lambda s: (s[0], -s[1])):
        if start >= end:
            found.append((SECRET, start, stop))
            end = stop
    return found


def _votes_and_form(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """The labelers' votes as one number, and the form of the span as bits."""
    body, before, after = text[start:end], text[max(0, start - 14) : start], text[end : end + 1]
    digits = sum(c.isascii() and c.isdigit() for c in body)
    letters = sum(c.isascii() and c.isalpha() for c in body)
    upper = any("A" <= c <= "Z" for c in body)
    near = before.lower()
    form = gazetteer = context = boundary = check = ABSTAIN
    if kind == EMAIL:
        form = YES if not body.startswith(".") and ".." not in body else NO
        gazetteer = YES if body.rpartition(".")[2].lower() in _TOP_DOMAINS else NO
        check = YES if letters > digits else ABSTAIN
    elif kind == IP:
        form = YES if all(p == "0" or not p.startswith("0") for p in body.split(".")) else NO
        gazetteer = NO if body.startswith(("0.", "255.")) else ABSTAIN
        check = NO if body.count(".") != 3 or near.rstrip().endswith(("version", "v")) else YES
    elif kind == CARD:
        form = YES if digits in (13, 14, 15, 16, 19) else NO
        gazetteer = YES if body[0] in "3456" else NO
        check = YES if luhn(body.replace(" ", "").replace("-", "")) else NO
    elif kind == PHONE:
        form = YES if _GROUPED_PHONE.search(body) else ABSTAIN
        code = re.match(r"\+([0-9]{1,3})", body)
        gazetteer = ABSTAIN if not code else YES if any(code[1][:n] in _COUNTRY_CODES for n in (1, 2, 3)) else NO
        check = YES if 9 <= digits <= 15 else NO
    else:
        form = YES if _HEX.fullmatch(body) or _HEADED.fullmatch(body) else ABSTAIN
        gazetteer = YES if body.startswith(_SECRET_HEADS) or re.search(r"(?i)(passw|pwd|token|secret|key)", near) else ABSTAIN
        check = YES if len(body) >= 12 and digits and letters and len(set(body)) >= 8 else NO
    if any(cue in near for cue in _CUES[kind]):
        context = YES
    glued = before[-1:].isalnum() or after.isalnum()
    boundary = NO if glued else YES
    votes = 0
    for vote in (form, gazetteer, context, boundary, check):
        votes = votes * 3 + vote
    size = min(3, (end - start) // 10)
    share = min(3, 4 * digits // max(1, end - start))
    bits = (size, share, int(upper), int(letters > 0), int(glued), int(context == YES), int(before[-1:] in "=\"':"))
    return votes, _packed(bits)


_FORM_SIZES = (4, 4, 2, 2, 2, 2, 2)


def _packed(values: tuple[int, ...]) -> int:
    code = 0
    for value, size in zip(values, _FORM_SIZES, strict=True):
        code = code * size + value
    return code


def candidates(text: str, raw: bytes) -> list[Candidate]:
    """(kind, start, end, votes, form, base): base spans, and proposed ones that overlap none of them."""
    base = base_spans(text, raw)
    starts, reach = [], []
    for s, e in sorted((s, e) for _, s, e in base):
        starts.append(s)
        reach.append(max(e, reach[-1]) if reach else e)
    out = [(k, s, e, *_votes_and_form(text, k, s, e), True) for k, s, e in base]
    for k, s, e in _proposed(text, raw):
        before = bisect_left(starts, e)
        if not before or reach[before - 1] <= s:
            out.append((k, s, e, *_votes_and_form(text, k, s, e), False))
    return out


class SpanModel:
    """Labeler reliabilities, and the classifier that was trained on what they imply."""

    def __init__(self, reliability: np.ndarray, weights: np.ndarray):
        self.reliability, self.weights = reliability, weights

    @staticmethod
    def votes_of(code: int) -> list[int]:
        return [code // 3**i % 3 for i in range(LABELERS - 1, -1, -1)]

    @staticmethod
    def features(kind: int, form: int) -> np.ndarray:
        parts = []
        for size in reversed(_FORM_SIZES):
            parts.append(np.eye(size)[form % size])
            form //= size
        kinds = np.eye(len(KINDS))[kind]
        return np.concatenate([kinds, *parts, np.outer(kinds, parts[-1]).ravel(), [1.0]])

    @classmethod
    def fit(cls, counts: dict[tuple[int, int, int], int], rounds: int = 40, steps: int = 400) -> SpanModel:
        """``counts``: how often each (kind, votes, form) was proposed. No counts: accepts nothing."""
        if not counts:
            return cls(np.full((len(KINDS), 2, LABELERS, 3), 1 / 3), np.zeros(len(cls.features(0, 0))))
        keys = sorted(counts)
        weight = np.array([counts[k] for k in keys], dtype=float)
        kind = np.array([k[0] for k in keys])
        votes = np.array([cls.votes_of(k[1]) for k in keys])
        yes, no = (votes == YES).sum(axis=1), (votes == NO).sum(axis=1)
        hit = (yes + 1.0) / (yes + no + 2.0)
        kinds = len(KINDS)
        for _ in range(rounds):
            prior = np.array([((hit * weight)[kind == k].sum() + 1) / (weight[kind == k].sum() + 2) for k in range(kinds)])
            # A labeler may be good at one kind and bad at another.
            reliability = np.ones((kinds, 2, LABELERS, 3))
            for labeler in range(LABELERS):
                told = (kind, votes[:, labeler])
                np.add.at(reliability[:, 1, labeler], told, hit * weight)
                np.add.at(reliability[:, 0, labeler], told, (1 - hit) * weight)
            reliability /= reliability.sum(axis=3, keepdims=True)
            logs = np.log(reliability)
            odds = np.log(prior[kind]) - np.log1p(-prior[kind])
            for labeler in range(LABELERS):
                odds = odds + logs[kind, 1, labeler, votes[:, labeler]] - logs[kind, 0, labeler, votes[:, labeler]]
            hit = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = np.array([cls.features(k[0], k[2]) for k in keys])
        share = np.sqrt(weight) / np.sqrt(weight).sum()
        w = np.zeros(x.shape[1])
        seen = np.full_like(w, 1e-8)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (share * (hit - p)) - 1e-4 * w
            seen += grad**2
            w += 0.3 * grad / np.sqrt(seen)
        return cls(reliability, w)

    def accepts(self, kind: int, form: int) -> bool:
        return bool(self.features(kind, form) @ self.weights > 0)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for raw in column_bytes(batch.column("text")):
        raw = raw or b""
        yield raw.decode("utf-8", "replace"), raw


def _texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit_spans(docs: DataFrame) -> SpanModel:
    """The model of a corpus: every proposed span of every text is counted by kind, votes and form."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, raw in _texts(batch):
                seen.update((c[0], c[3], c[4]) for c in candidates(text, raw))
        columns = list(zip(*[(*k, n) for k, n in seen.items()], strict=True)) or [()] * 4
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["kind", "votes", "form", "n"])

    counted = _texts_of(docs).select("text").mapInArrow(count, "kind long, votes long, form long, n long")
    rows = counted.groupBy("kind", "votes", "form").agg(F.sum("n").alias("n")).collect()
    return SpanModel.fit({(r.kind, r.votes, r.form): r.n for r in rows})


def _spans(text: str, raw: bytes, accepts) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, as (start, kind, end) in order."""
    proposed = candidates(text, raw)
    base = sorted((s, k, e) for k, s, e, _, _, is_base in proposed if is_base)
    every = sorted((s, k, e) for k, s, e, _, form, is_base in proposed if is_base or accepts(k, form))
    return base, every


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, spans of the base rules and all spans of every document.

    Columns n_email, n_ip, n_card, n_phone count base spans; base_spans and spans list
    kind:start:end in code points. A null or empty text has none; a null doc_id stays null; repeated
    rows are found alike; an empty table gives no rows. A text is searched whole, in time proportional
    to its length, numbers of any length included. Columns other than doc_id and text are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = lru_cache(None)(model.accepts)
        for batch in batches:
            counts, base_texts, texts = [], [], []
            for text, raw in _texts(batch):
                base, every = _spans(text, raw, accepts)
                kinds = Counter(k for _, k, _ in base)
                counts.append([kinds[k] for k in range(BASE_KINDS)])
                base_texts.append(_joined(base))
                texts.append(_joined(every))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE_KINDS)]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
            arrays = [batch.column("doc_id"), *numbers, pa.array(base_texts, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return _texts_of(docs).mapInArrow(
        find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    out, end = [], 0
    merged: list[list] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = e
    return "".join([*out, text[end:]])


def redact_personal_data(docs: DataFrame, model: SpanModel, kinds: Sequence[int] = PERSONAL) -> DataFrame:
    """The documents with spans of these kinds replaced; n_chars follows, all other columns stay.

    A null text stays null, and then n_chars is as it was; repeated rows are changed alike. A text is
    searched whole, in time proportional to its length. Spans that overlap are replaced as one, by the
    kind of the first. An empty table stays empty.
    """

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = lru_cache(None)(model.accepts)
        for batch in batches:
            texts, sizes = [], []
            for given, n_chars in zip(column_bytes(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True):
                if given is None:
                    texts.append(None)
                    sizes.append(n_chars)
                    continue
                text = given.decode("utf-8", "replace")
                new = redacted(text, [x for x in _spans(text, given, accepts)[1] if x[1] in kinds])
                texts.append(new)
                sizes.append(len(new))
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.withColumns({"text": F.col("text").cast("string"), "n_chars": F.col("n_chars").cast("long")})
    return rows.mapInArrow(replace, rows.schema)
