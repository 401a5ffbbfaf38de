"""Quality rules on line sequences: a linear-chain conditional random field marks boilerplate.

Every line is described by a few yes/no features. The field scores content and boilerplate for each
line and for each step between lines; Viterbi decoding picks the best sequence, and the share of a
document's words in content lines decides whether it stays.

Labels are given for documents only, so the lines' states are latent and found by expectation
maximisation on a bounded sample. The expected states of a bad document are shifted until most of its
words are boilerplate, and those of a good one until nearly all are content; which of a bad document's
lines are bad, and how often states change from line to line, the field learns from all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes

#: Bound of the fit sample: documents of each label, those with the smallest digest of their id, and
#: lines of a document (a longer one takes part with so many consecutive lines, from a digest of its id).
FIT_DOCS, FIT_LINES = 600, 96
#: Rounds of expectation maximisation, steps of ascent in each.
FIT_ROUNDS, FIT_STEPS, FIT_STEP, FIT_DECAY = 4, 50, 0.5, 1e-3
#: Expected share of a document's words in content lines: at most, if bad, and at least, if good.
BAD_AT_MOST, GOOD_AT_LEAST = 0.4, 0.97
KEEP_SHARE = 0.5
WINDOW = 3

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_CONTINUED = bytes(range(0x80, 0xC0))

FEATURES = (
    "always",
    "no word",
    "one or two words",
    "three to seven words",
    "symbols over 2%",
    "symbols over 8%",
    "capitals over 30% of letters",
    "capitals over 60% of letters",
    "digits over 10%",
    "exclamation marks over 3%",
    "seen before in the document",
    "under half of the words distinct",
    "a word repeated next to itself in over a fifth",
    "under a fifth of the words ends a clause",
    "mean word over 15 bytes",
    "ends a sentence",
    "bars between words",
)


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[bool]:
    n, size = len(words), max(1, len(line))
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    letters = max(1, len(line) - len(line.translate(None, _LETTERS)))
    capitals = len(line) - len(line.translate(None, _UPPER))
    digits = len(line) - len(line.translate(None, _DIGITS))
    repeated = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    last = words[-1][-1:] if n else b""
    return [
        True,
        n == 0,
        0 < n < 3,
        3 <= n < 8,
        symbols > 0.02 * size,
        symbols > 0.08 * size,
        capitals > 0.3 * letters,
        capitals > 0.6 * letters,
        digits > 0.1 * size,
        line.count(b"!") > 0.03 * size,
        seen,
        n >= 8 and 2 * len(set(words)) < n,
        n >= 4 and 5 * repeated > n,
        n >= 15 and 20 * (line.count(b".") + line.count(b",")) < n,
        n > 0 and len(line) > 15 * n,
        last in b".!?" and n > 0,
        n > 2 and line.count(b" | ") * 4 > n,
    ]


def described(text: bytes | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, words per line."""
    raw = text or b""
    seen: set[bytes] = set()
    numbers: dict[bytes, int] = {}
    features, counts, ids, duplicates = [], [], [], 0
    for line in raw.split(b"\n"):
        words = line.split()
        again = bool(words) and line in seen
        duplicates += again
        if words:
            seen.add(line)
            ids += [numbers.setdefault(w, len(numbers)) for w in words]
        features.append(line_features(line, words, again))
        counts.append(len(words))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    chars = len(raw.translate(None, _SPACE + _CONTINUED))
    repeats = repeated_words(np.array(ids, dtype=np.int64), len(numbers))
    return (len(ids), chars, symbols, duplicates, repeats), np.array(features, dtype=np.float32), np.array(counts)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(ids) <= WINDOW:
        return 0
    if distinct < 1 << 21:
        codes = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # number the pairs first, so that three numbers fit
        _, pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
        codes = pairs * distinct + ids[2:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, codes), len(twice) - 1)
    inside = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice[at] == codes)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + WINDOW, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


class LineField:
    """Linear-chain conditional random field with the states boilerplate (0) and content (1)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    @classmethod
    def fit(cls, documents: list[np.ndarray], labels: list[int], words: list[np.ndarray] | None = None) -> LineField:
        """Expectation maximisation over documents' line features, labels and words per line (or 1 each)."""
        features = documents[0].shape[1] if documents else len(FEATURES)
        field = cls(np.zeros((features, 2)), np.zeros((2, 2)))
        if not documents:
            return field
        most = max(len(d) for d in documents)
        x = np.zeros((len(documents), most, features))
        mask = np.zeros((len(documents), most))
        sizes = np.zeros((len(documents), most))
        for i, d in enumerate(documents):
            x[i, : len(d)], mask[i, : len(d)] = d, 1
            sizes[i, : len(d)] = 1 if words is None else words[i] + 1e-3
        y = np.array(labels)
        # Every document counts alike, and both labels count alike.
        per_line = mask / mask.sum(axis=1, keepdims=True) / len(documents)
        balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        per_line = per_line * balance[:, None]
        flat = x.reshape(-1, features)
        want = np.zeros((*mask.shape, 2))
        want[np.arange(len(y))[:, None], np.arange(most)[None, :], y[:, None]] = 1
        have = np.zeros((len(y), most - 1, 2, 2))
        for round_ in range(FIT_ROUNDS):
            if round_:
                # The first expectation looks at lines alone: the steps are from one state a document.
                told = field if round_ > 1 else cls(field.weights, np.zeros((2, 2)))
                want, have = told._expected((flat @ told.weights).reshape(*mask.shape, 2), mask, sizes, y)
            else:
                have[np.arange(len(y)), :, y, y] = mask[:, 1:]
            field = cls(np.zeros((features, 2)), np.zeros((2, 2)))
            moments_w, moments_s = np.zeros_like(field.weights), np.zeros_like(field.steps)
            for _ in range(FIT_STEPS):
                single, double = field._marginals((flat @ field.weights).reshape(*mask.shape, 2), mask)
                down = ((want - single) * per_line[..., None]).reshape(-1, 2)
                grad_w = flat.T @ down - FIT_DECAY * field.weights
                grad_s = ((have - double) * per_line[:, 1:, None, None]).sum(axis=(0, 1)) - FIT_DECAY * field.steps
                moments_w += grad_w**2
                moments_s += grad_s**2
                field.weights = field.weights + FIT_STEP * grad_w / (np.sqrt(moments_w) + 1e-8)
                field.steps = field.steps + FIT_STEP * grad_s / (np.sqrt(moments_s) + 1e-8)
        return field

    def _expected(self, scores, mask, sizes, y) -> tuple[np.ndarray, np.ndarray]:
        """Expected states of lines and of steps, each document's shifted until its label's share is met."""
        single, double = self._marginals(scores, mask)
        logit = np.log(single[..., 1] + 1e-9) - np.log(single[..., 0] + 1e-9)
        share = sizes / sizes.sum(axis=1, keepdims=True)

        def content(shift):
            return (share / (1 + np.exp(-np.clip(logit + shift[:, None], -60, 60)))).sum(axis=1)

        low, high = np.full(len(y), -60.0), np.full(len(y), 60.0)
        aim = np.where(y == 1, GOOD_AT_LEAST, BAD_AT_MOST)
        for _ in range(40):
            middle = (low + high) / 2
            under = content(middle) < aim
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        now = content(np.zeros(len(y)))
        met = np.where(y == 1, now >= aim, now <= aim)
        shift = np.where(met, 0.0, (low + high) / 2)
        tilt = np.exp(np.clip(shift, -30, 30) / 2)[:, None]
        odds = np.stack([single[..., 0] / tilt, single[..., 1] * tilt], axis=-1)
        want = odds / np.maximum(odds.sum(axis=-1, keepdims=True), 1e-300) * mask[..., None]
        state = np.stack([1 / tilt[:, 0], tilt[:, 0]], axis=-1)
        pairs = double * state[:, None, :, None] * state[:, None, None, :]
        have = pairs / np.maximum(pairs.sum(axis=(2, 3), keepdims=True), 1e-300) * mask[:, 1:, None, None]
        return want, have

    def _marginals(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over all documents at once; lines past a document's end change nothing."""
        n, most, _ = scores.shape
        ahead = np.zeros_like(scores)
        back = np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, most):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.steps, axis=1) + scores[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, step, ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = np.logaddexp.reduce(self.steps + (scores[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        single = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        double = ahead[:, :-1, :, None] + self.steps + (scores[:, 1:] + back[:, 1:])[:, :, None, :]
        double = np.exp(np.minimum(double - total[:, None, None, None], 0)) * mask[:, 1:, None, None]
        return single, double

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Most likely states of a document's lines; content where two sequences tie."""
        scores = (features @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.steps.tolist()
        boiler, content = scores[0]
        came: list[tuple[int, int]] = []
        for s0, s1 in scores[1:]:
            to0, to1 = int(content + cb >= boiler + bb), int(content + cc >= boiler + bc)
            came.append((to0, to1))
            boiler, content = (
                (content + cb if to0 else boiler + bb) + s0,
                (content + cc if to1 else boiler + bc) + s1,
            )
        state = int(content >= boiler)
        states = [state]
        for back in reversed(came):
            state = back[state]
            states.append(state)
        return np.array(states[::-1], dtype=bool)


def fit_field(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCS, most_lines: int = FIT_LINES) -> LineField:
    """The field of ``labels.quality``; the lines are described in Spark, the fit sample is bounded.

    A document with several labels has the larger; null or other labels, and labels without a
    document, are left out before the sample is taken. Of documents that share a doc_id each takes
    part. A document with more than ``most_lines`` takes part with so many consecutive lines.
    """
    key = F.xxhash64("doc_id", F.lit(3))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Few rows a label are chosen before texts are read.
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").cast("int").alias("quality")
    )
    marked = marked.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("quality") == label).orderBy(key, "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("_from", F.xxhash64("doc_id", F.lit(4)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, counts = [], []
            for text, place in zip(column_bytes(batch.column("text")), batch.column("_from").to_pylist(), strict=True):
                _, features, words = described(text)
                at = place % max(1, len(words) - most_lines + 1)
                lines.append(features[at : at + most_lines].astype(np.uint8).tobytes())
                counts.append(words[at : at + most_lines].astype(np.int32).tobytes())
            arrays = [batch.column("doc_id"), batch.column("quality"), pa.array(lines, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "quality", "lines", "words"])

    described_rows = rows.select("doc_id", "quality", "text", "_from").mapInArrow(
        describe, "doc_id long, quality int, lines binary, words binary"
    )
    sample = described_rows.orderBy("doc_id", "quality", "lines", "words").limit(2 * per_label).collect()
    lines = [np.frombuffer(bytes(r.lines), dtype=np.uint8).reshape(-1, len(FEATURES)).astype(np.float64) for r in sample]
    words = [np.frombuffer(bytes(r.words), dtype=np.int32).astype(np.float64) for r in sample]
    return LineField.fit(lines, [r.quality for r in sample], words)


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, content_words long"
)


def judge_lines(docs: DataFrame, field: LineField, share: float = KEEP_SHARE) -> DataFrame:
    """Counts and verdict of every document.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and at least ``share`` of the words in content lines. A null or empty text has one
    line without words and fails; a null doc_id stays null; repeated rows are judged alike; an empty
    table gives no rows. A text is judged whole, however long, in time proportional to its length.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in column_bytes(batch.column("text")):
                counts, features, words = described(text)
                n, repeats = counts[0], counts[4]
                failed = n < 50 or 100 * repeats > 50 * n
                content = int(words[field.decode(features)].sum())
                rows.append((*counts, failed, not failed and content >= share * n, len(words), content))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [part.split()[0] for part in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, RESULT)
