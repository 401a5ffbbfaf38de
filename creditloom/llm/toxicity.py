"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as a word vector and as the largest values of its character n-gram vectors, so
that unseen forms of a known stem are read as well. Two gated recurrences read each window of words
forwards and backwards, attention weighs their states, and a logistic unit scores the window. All
overlapping windows of a text are scored; its score is that of its worst window.

The network is trained in numpy on a bounded sample. A label holds for a text and not for its
windows, so every epoch trains on the window that the network finds worst in each text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, held_out, kept_in_store, slices, word_count, words

#: Bound of the fit sample: clean and toxic documents, those with the smallest digest of their id, and
#: words of a document (of a longer clean one so many consecutive words, from a digest of its id; a longer
#: toxic one is not in the sample, because nobody says which of its words are meant).
FIT_DOCS, FIT_WORDS = (2500, 1000), 1200
FOLDS = 5
WINDOW, STRIDE = 24, 12
WORD_SIZE, CHAR_SIZE, HIDDEN = 4, 6, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 16
GRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 6, 128, 0.01
THRESHOLD = 0.5
#: Windows that go through the network together, and distinct words a task remembers.
LANES, KNOWN_WORDS = 4096, 250_000
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """Distinct words as rows of the two embedding tables; ``grams`` holds all words' n-grams."""

    word: np.ndarray
    grams: np.ndarray
    starts: np.ndarray


def word_rows(words: list[bytes], at_once: int = 25_000) -> Words:
    """Rows of distinct words; many words are hashed in parts, which bounds what is held meanwhile."""
    if len(words) <= at_once:
        return _word_rows(words)
    parts = [_word_rows(words[at : at + at_once]) for at in range(0, len(words), at_once)]
    sizes = np.cumsum([0] + [len(p.grams) for p in parts])
    starts = np.concatenate([p.starts + size for p, size in zip(parts, sizes, strict=False)])
    return Words(np.concatenate([p.word for p in parts]), np.concatenate([p.grams for p in parts]), starts)


def _word_rows(words: list[bytes]) -> Words:
    marked = [b"<" + (w.strip(_EDGES) or w) + b">" for w in words]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    flat = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    room = np.repeat(ends, sizes) - np.arange(len(flat))
    with np.errstate(over="ignore"):
        mixed = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolled, grams, owners = flat + np.uint64(7), [], []
        owner = np.repeat(np.arange(len(words)), sizes)
        for length in range(2, max(GRAMS) + 1):
            rolled = rolled[:-1] * np.uint64(0x100000001B3) ^ (mixed[length - 1 :] >> np.uint64(20))
            if length in GRAMS:
                inside = np.flatnonzero(room[: len(rolled)] >= length)
                grams.append((rolled[inside] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)).astype(np.int64))
                owners.append(owner[inside])
        # A word has three bytes at least with its marks, so each has an n-gram.
        position = np.arange(len(flat), dtype=np.uint64) - np.repeat(begins, sizes).astype(np.uint64)
        whole = np.add.reduceat(mixed * (np.uint64(2) * position + np.uint64(1)), begins) if len(words) else mixed[:0]
        word = (whole * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(49)).astype(np.int64)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return Words(word, grams[order] % CHAR_BUCKETS, np.cumsum(counts) - counts)


def window_starts(n_words: int) -> list[int]:
    """Starts of overlapping windows that cover a text; the last one ends with the text."""
    if n_words <= WINDOW:
        return [0]
    starts = list(range(0, n_words - WINDOW, STRIDE))
    return [*starts, n_words - WINDOW]


def _cut(scores: np.ndarray, labels: np.ndarray, clean_weight: float = 3.0) -> float:
    """A threshold in the best range, nearer its upper end; a clean document lost weighs ``clean_weight``."""
    order = np.argsort(scores)
    scores, labels = scores[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(labels == 1)])
    flagged = (labels == 0).sum() - np.concatenate([[0], np.cumsum(labels == 0)])
    cost = missed + clean_weight * flagged
    best = np.flatnonzero(cost == cost.min())
    bounds = np.concatenate([[scores[0] - 1], scores, [scores[-1] + 1]]) if len(scores) else np.zeros(3)
    return float(bounds[best[0]] * 0.25 + bounds[best[-1] + 1] * 0.75)


class ToxicityNet:
    """Weights by name: word, char (tables); w, u, b of both directions; attend; out, bias."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def new(cls, seed: int = 5) -> ToxicityNet:
        rng = np.random.default_rng(seed)
        inputs = WORD_SIZE + CHAR_SIZE

        def small(*shape, scale=None):
            return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        weights = {"word": small(WORD_BUCKETS, WORD_SIZE, scale=0.02), "char": small(CHAR_BUCKETS, CHAR_SIZE, scale=0.02)}
        for side in "fb":
            weights[f"w{side}"], weights[f"u{side}"] = small(inputs, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN)
            weights[f"b{side}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        weights |= {"attend": small(2 * HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32)}
        return cls(weights)

    def vectors(self, rows: Words) -> np.ndarray:
        """Input vectors of distinct words, with a last row of zeros for the places after a text."""
        out = np.zeros((len(rows.word) + 1, WORD_SIZE + CHAR_SIZE), dtype=np.float32)
        out[:-1, :WORD_SIZE] = self.weights["word"][rows.word]
        step = 20_000
        for at in range(0, len(rows.word), step):
            starts = rows.starts[at : at + step]
            stop = rows.starts[at + step] if at + step < len(rows.word) else len(rows.grams)
            values = self.weights["char"][rows.grams[starts[0] : stop]]
            out[at : at + len(starts), WORD_SIZE:] = np.maximum.reduceat(values, starts - starts[0], axis=0)
        return out

    def _read(self, side: str, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None):
        """States of one direction, (places, windows, hidden). ``ids``: rows of ``projected``."""
        u = self.weights[f"u{side}"]
        lanes, places = ids.shape
        states = np.zeros((places, lanes, HIDDEN), dtype=np.float32)
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        padded = not mask.all()
        for t in range(places) if side == "f" else range(places - 1, -1, -1):
            x, g = projected.take(ids[:, t], axis=0), h @ u
            gates = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
            gates *= 0.5  # the logistic function by the hyperbolic tangent, which is faster
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if padded:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, g))
            states[t] = h = new
        return states

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        scores = states @ self.weights["attend"]
        scores = np.where(mask.T, scores, -1e9)
        scores = np.exp(scores - scores.max(axis=0))
        attention = scores / scores.sum(axis=0)
        pooled = np.einsum("tl,tlh->lh", attention, states)
        pooled = pooled * mask.any(axis=1)[:, None]
        return attention, pooled, pooled @ self.weights["out"] + self.weights["bias"][0]

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {s: vectors @ self.weights[f"w{s}"] + self.weights[f"b{s}"] for s in "fb"}

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, none: int) -> np.ndarray:
        """Logit of each window; ``ids`` (windows, places) are rows of ``projected``, ``none``: no word."""
        out = np.empty(len(ids), dtype=np.float32)
        for at in range(0, len(ids), LANES):
            part = ids[at : at + LANES]
            mask = part != none
            states = np.concatenate([self._read(s, projected[s], part, mask) for s in "fb"], axis=2)
            out[at : at + LANES] = self._pool(states, mask)[2]
        return out

    def gradients(self, rows: Words, ids: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss of windows, by backpropagation through time."""
        vectors = self.vectors(rows)
        mask = ids != len(vectors) - 1
        projected = self.projected(vectors)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._read(s, projected[s], ids, mask, kept[s]) for s in "fb"], axis=2)
        attention, pooled, logits = self._pool(states, mask)
        down = ((_sigmoid(logits) - labels) * weight).astype(np.float32)
        attend, out = self.weights["attend"], self.weights["out"]
        grads = {"out": pooled.T @ down, "bias": np.array([down.sum()], dtype=np.float32)}
        d_pooled = down[:, None] * out * mask.any(axis=1)[:, None]
        d_attention = np.einsum("lh,tlh->tl", d_pooled, states)
        d_scores = attention * (d_attention - (attention * d_attention).sum(axis=0))
        grads["attend"] = np.einsum("tl,tlh->h", d_scores, states)
        d_states = attention[..., None] * d_pooled + d_scores[..., None] * attend
        d_vectors = np.zeros_like(vectors)
        for i, s in enumerate("fb"):
            u, w = self.weights[f"u{s}"], self.weights[f"w{s}"]
            d_u, d_projected = np.zeros_like(u), np.zeros_like(projected[s])
            carry = np.zeros((len(ids), HIDDEN), dtype=np.float32)
            for t, h, z, r, n, g in reversed(kept[s]):
                total = carry + d_states[t, :, i * HIDDEN : (i + 1) * HIDDEN]
                live = total * mask[:, t, None]
                d_n = live * (1 - z) * (1 - n**2)
                d_z = live * (h - n) * z * (1 - z)
                d_r = d_n * g[:, 2 * HIDDEN :] * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += h.T @ d_g
                np.add.at(d_projected, ids[:, t], d_x)
                carry = d_g @ u.T + live * z + total * ~mask[:, t, None]
            grads[f"u{s}"], grads[f"b{s}"] = d_u, d_projected.sum(axis=0)
            grads[f"w{s}"] = vectors.T @ d_projected
            d_vectors += d_projected @ w.T
        grads["word"], grads["char"] = np.zeros_like(self.weights["word"]), np.zeros_like(self.weights["char"])
        np.add.at(grads["word"], rows.word, d_vectors[:-1, :WORD_SIZE])
        sizes = np.diff(np.append(rows.starts, len(rows.grams)))
        best = self.weights["char"][rows.grams] == np.repeat(vectors[:-1, WORD_SIZE:], sizes, axis=0)
        np.add.at(grads["char"], rows.grams, best * np.repeat(d_vectors[:-1, WORD_SIZE:], sizes, axis=0))
        return grads

    @classmethod
    def fit(cls, texts: list[list[bytes]], labels: np.ndarray, seed: int = 5) -> ToxicityNet:
        """``texts``: the words of each document; ``fit_coded`` of their numbers."""
        numbers: dict[bytes, int] = {}
        coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], dtype=np.int32) for t in texts]
        return cls.fit_coded(list(numbers), coded, labels, seed)

    @classmethod
    def fit_coded(cls, words: list[bytes], coded: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> ToxicityNet:
        """``coded``: each document's words as places in ``words``. Without both labels the network answers 0.

        Every fourth document only sets the bias, to where fewest of them are on the wrong side. Windows
        are numbered over all documents and cut from the words when they are read, some at a time.
        """
        net = cls.new(seed)
        if len(set(labels.tolist())) < 2:
            net.weights["out"][:] = 0
            net.weights["bias"][:] = -8
            return net
        rows = word_rows(words)
        none = len(words)
        begins = np.cumsum([0] + [len(ids) for ids in coded])
        flat = np.concatenate([*coded, np.full(WINDOW, none)]).astype(np.int32)
        starts = [np.array(window_starts(len(ids))) + at for ids, at in zip(coded, begins, strict=False)]
        owner = np.repeat(np.arange(len(coded)), [len(x) for x in starts])
        starts = np.concatenate(starts)

        def windows(which: np.ndarray) -> np.ndarray:
            places = starts[which, None] + np.arange(WINDOW)
            return np.where(places < begins[owner[which] + 1, None], flat[places], none)

        def judged(which: np.ndarray, judge) -> np.ndarray:
            parts = [judge(windows(which[at : at + LANES])) for at in range(0, len(which), LANES)]
            return np.concatenate(parts) if parts else np.zeros(0)

        aside = np.zeros(len(coded), dtype=bool)
        for label in (0, 1):
            aside[np.flatnonzero(labels == label)[3::4]] = True
        learn = np.flatnonzero(~aside[owner])
        net._start_from_counts(rows, [coded[i] for i in np.flatnonzero(~aside)], labels[~aside])
        rng = np.random.default_rng(seed)
        balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * len(labels)
        # Moments of the tables only for the rows that a word of the sample uses.
        used_rows = {"word": np.unique(rows.word), "char": np.unique(rows.grams)}
        first = {k: np.zeros_like(v[used_rows[k]] if k in used_rows else v) for k, v in net.weights.items()}
        second = {k: np.zeros_like(v) for k, v in first.items()}
        step = 0
        strength = net.vectors(rows)[:, [0, WORD_SIZE]].sum(axis=1)
        for epoch in range(EPOCHS):
            if epoch:
                tables = net.projected(net.vectors(rows))
                found = judged(learn, lambda ids, tables=tables: net.logits(tables, ids, none))
                del tables
            else:
                found = judged(learn, lambda ids: strength[ids].max(axis=1))
            order = learn[np.lexsort((found, owner[learn]))]
            worst = order[np.append(owner[order][1:] != owner[order][:-1], True)]
            some = rng.choice(learn[labels[owner[learn]] == 0], size=(labels == 0).sum())
            chosen = rng.permutation(np.concatenate([worst, some]))
            for at in range(0, len(chosen), BATCH):
                batch = chosen[at : at + BATCH]
                used, ids = np.unique(windows(batch), return_inverse=True)
                ids = ids.reshape(len(batch), WINDOW)
                has_none = used[-1] == none
                real = used[:-1] if has_none else used
                grads = net.gradients(_some(rows, real), ids, labels[owner[batch]], balance[owner[batch]] / len(batch))
                step += 1
                for name, grad in grads.items():
                    own = used_rows.get(name, slice(None))
                    grad = grad[own]
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.01 * (grad**2 - second[name])
                    rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    net.weights[name][own] -= rate * first[name] / (np.sqrt(second[name]) + 1e-6)
        firsts = np.searchsorted(owner, np.arange(len(coded)))
        tables = net.projected(net.vectors(rows))
        found = judged(np.arange(len(owner)), lambda ids: net.logits(tables, ids, none))
        worst = np.maximum.reduceat(found, firsts)
        net.weights["bias"] -= np.float32(_cut(worst[aside], labels[aside]))
        return net

    def _start_from_counts(self, rows: Words, coded: list[np.ndarray], labels: np.ndarray) -> None:
        """First dimension of both tables: how much more often toxic documents have a word or n-gram."""
        ends = np.append(rows.starts, len(rows.grams))
        for table, buckets in (("word", WORD_BUCKETS), ("char", CHAR_BUCKETS)):
            seen = np.ones((2, buckets))
            for ids, label in zip(coded, labels, strict=True):
                distinct = np.unique(ids)
                if table == "word":
                    there = np.unique(rows.word[distinct])
                else:
                    parts = [rows.grams[ends[i] : ends[i + 1]] for i in distinct]
                    there = np.unique(np.concatenate(parts)) if parts else distinct
                seen[int(label), there] += 1
            odds = np.log(seen[1] / ((labels == 1).sum() + 2)) - np.log(seen[0] / ((labels == 0).sum() + 2))
            self.weights[table][:, 0] += (odds / 2).astype(np.float32)


def _some(rows: Words, wanted: np.ndarray) -> Words:
    ends = np.append(rows.starts, len(rows.grams))
    sizes = ends[wanted + 1] - ends[wanted]
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(ends[wanted], sizes)
    return Words(rows.word[wanted], rows.grams[at], starts)


class Scorer:
    """Scores texts; remembers the projected vectors of words, and starts anew when they are many."""

    def __init__(self, net: ToxicityNet, most_words: int = KNOWN_WORDS):
        self.net, self.most = net, most_words
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        self.tables = self.net.projected(np.zeros((1, WORD_SIZE + CHAR_SIZE), dtype=np.float32))
        self.filled = 1

    def _learn(self) -> None:
        new = list(islice(self.numbers, self.filled - 1, None))
        if not new:
            return
        vectors = self.net.vectors(word_rows(new))[:-1]
        need = self.filled + len(new)
        for side, rows in self.net.projected(vectors).items():
            if need > len(self.tables[side]):
                grown = np.empty((max(need, min(2 * need, self.most)), rows.shape[1]), dtype=np.float32)
                grown[: self.filled] = self.tables[side][: self.filled]
                self.tables[side] = grown
            self.tables[side][self.filled : need] = rows
        self.filled = need

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Score of each text: the largest of its windows. A text without words has one empty window."""
        if not texts:
            return np.zeros(0)
        if len(self.numbers) > self.most:
            self._forget()
        number, ids, starts, firsts, short = self.numbers.__getitem__, [], [], [], []
        for text in texts:
            words = (text or b"").lower().split()
            first = len(ids)
            ids.extend(map(number, words))
            firsts.append(len(starts))
            if len(words) < WINDOW:
                short.append((len(starts), first, len(words)))
                starts.append(0)
            else:
                starts += [first + s for s in window_starts(len(words))]
        self._learn()
        flat = np.array([*ids, *[0] * WINDOW], dtype=np.int32)
        windows = flat[np.array(starts)[:, None] + np.arange(WINDOW)]
        for row, first, n in short:
            windows[row] = 0
            windows[row, :n] = flat[first : first + n]
        return _sigmoid(np.maximum.reduceat(self.net.logits(self.tables, windows, 0), firsts)).astype(np.float64)


def numbered(sample: DataFrame) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Distinct words of a sample in byte order, each text as places in them, and its label; numbered in Spark."""
    sample = kept_in_store(sample, "toxicity-sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = set()
            for text in column_bytes(batch.column("text")):
                words.update((text or b"").lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary())], ["word"])

    found = sample.select("text").mapInArrow(split, "word binary").distinct().orderBy("word").toArrow()
    listed = found.column("word").combine_chunks()
    shared = sample.sparkSession.sparkContext.broadcast(listed.to_pylist())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            ids = [[places[w] for w in (t or b"").lower().split()] for t in column_bytes(batch.column("text"))]
            ids = pa.array([np.array(x, dtype=np.int32).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("toxic"), ids], ["doc_id", "text", "toxic", "ids"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    coded = sample.mapInArrow(number, f"doc_id {kind}, text string, toxic int, ids binary").orderBy("doc_id", "text").select("toxic", "ids").toArrow()
    ids = [np.frombuffer(x.as_py(), dtype=np.int32) for x in coded.column("ids")]
    return shared.value, ids, coded.column("toxic").to_numpy().astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = FIT_DOCS, most_words: int = FIT_WORDS) -> ToxicityNet:
    """The network of ``labels.toxic``, learned from documents that are not held out.

    Of several labels of a document the larger counts; null and other labels, and those without a
    document, are left out before the sample is taken, as are toxic documents over ``most_words``.
    Documents that share a doc_id take part each; without any label the network knows nothing.
    """
    key = F.xxhash64("doc_id", F.lit(5))
    marked = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", FOLDS))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_words = word_count(F.coalesce("text", F.lit(""))).alias("n")
    sized = texts.join(marked, F.col("doc_id") == F.col("_id")).select("doc_id", "_toxic", n_words)
    fit = sized.where((F.col("_toxic") == 0) | (F.col("n") <= most_words)).groupBy("doc_id").agg(F.max("_toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = fit.where(F.col("toxic") == label).orderBy(key, "doc_id").limit(per_label[label])
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = F.broadcast(chosen.withColumnRenamed("doc_id", "_id"))
    parts = words(F.coalesce("text", F.lit("")))
    rows = texts.join(picked, F.col("doc_id") == F.col("_id")).withColumn("_words", parts).withColumn("_n", F.size("_words"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.col("_n") - most_words + 1).cast("int") + 1
    cut = F.array_join(F.slice("_words", place, most_words), " ")
    sample = (
        rows.where((F.col("toxic") == 0) | (F.col("_n") <= most_words))
        .select("doc_id", "toxic", F.when(F.col("_n") > most_words, cut).otherwise(F.col("text")).alias("text"))
        .orderBy("doc_id", "text")
        .limit(sum(per_label))
    )
    return ToxicityNet.fit_coded(*numbered(sample))


def score_toxicity(docs: DataFrame, net: ToxicityNet, out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and ``out``, 0 to 1, which replaces a column of that name. Null and empty texts are scored as no words."""
    model = docs.sparkSession.sparkContext.broadcast(net.weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ToxicityNet(model.value))
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                scores = scorer.score(column_bytes(batch.column("text")))
                columns = [batch.column(n) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], [*batch.schema.names, out])

    rows = docs.withColumn("text", F.col("text").cast("string")).drop(out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(score, f"{schema}, `{out}` double")
