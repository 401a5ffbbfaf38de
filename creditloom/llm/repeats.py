"""Periodic runs of words by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q that neither neighbour extends and
that is long enough, at least MOST_SHORT words and LEAST_POWER periods. The word following the last
full square of a run breaks its period, so the run's last two periods start at suffixes i and i + q
that share exactly q words: they lie in different children of an LCP interval of depth q. For every
boundary between children the suffixes of the smaller side are taken, and the inverse suffix array
tells whether the suffix q words on, or q words back, lies on the other side. Each hit is the last
square of a run; rotating it to the left as far as words agree gives the run's start, and squares of
several periods that end together are one run with the smallest of them. Nothing but arrays is kept.

Documents are worked on in blocks, one suffix array for all texts of a block. Suffixes are sorted by
doubling, within a document only, and no further than a period can reach.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, slices

#: A run has at least so many words, and at least so many periods.
MOST_SHORT = 6
LEAST_POWER = 4
#: Words of a block of texts; a longer text is a block alone.
BLOCK_WORDS = 400_000
#: Suffixes tested at once.
CHUNK = 1 << 20

Run = tuple[int, int, int]


def _boundaries(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where a sorted key differs from the one before."""
    first = np.empty(len(order), dtype=bool)
    first[:1] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return first


class SuffixArray:
    """Suffixes of each text of a block in order, their inverse, and common lengths of neighbours.

    ``words``: numbers from 1, with a 0 after every text; ``text``: the text of each position;
    ``reach``: words of a text's suffixes that matter. Neighbours that share as many or more are left
    in any order, with some shared length of at least that.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, reach: np.ndarray):
        n, base = len(words), int(words.max()) + 1
        key = (text * base + words) * base
        key[:-1] += words[1:]
        self.order = np.argsort(key)
        key = key[self.order]
        first = _boundaries(self.order, key)
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, k = [(2, rank.astype(np.int32))], 2
        alone = first & np.append(first[1:], True)
        active = np.flatnonzero(~alone)
        needed = reach[text]
        while len(active := active[needed[self.order[active]] > k]):
            at = self.order[active]
            key = rank[at] * n + rank[at + k]
            turn = np.argsort(key)
            key, at = key[turn], at[turn]
            self.order[active] = at
            first = _boundaries(at, key)
            rank[at] = np.maximum.accumulate(np.where(first, active, 0))
            k *= 2
            levels.append((k, rank.astype(np.int32)))
            active = active[~(first & np.append(first[1:], True))]
        self.inverse = np.empty(n, dtype=np.int64)
        self.inverse[self.order] = np.arange(n)
        self.shared = self._shared(words, text, needed, levels)

    def _shared(self, words, text, needed, levels) -> np.ndarray:
        """Words that suffix j shares with the one before it, by the ranks of every doubling."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(len(words), dtype=np.int64)
        pairs = np.flatnonzero((words[a] == words[b]) & (text[a] == text[b]) & (words[a] > 0))
        shared[pairs + 1] = 1
        pairs = pairs[levels[0][1][a[pairs]] == levels[0][1][b[pairs]]]
        a, b, need = a[pairs], b[pairs], needed[self.order[pairs]]
        found = np.zeros(len(pairs), dtype=np.int64)
        for k, rank in reversed(levels):
            # A text's suffixes were sorted by k words only while k/2 was less than it needed.
            same = np.flatnonzero((rank[a] == rank[b]) & ((need > k // 2) | (k == 2)) & (found < need))
            found[same] += k
            a[same] += k
            b[same] += k
        open_ = np.flatnonzero(found < need)
        found[open_] += (words[a[open_]] == words[b[open_]]) & (words[a[open_]] > 0)
        shared[pairs + 1] = found
        return shared

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """For boundary j: left side from the first value to j - 1, right side from j to before the second."""
        n, shared = len(self.shared), np.append(self.shared, -1)
        left, right = np.arange(n) - 1, np.arange(n) + 1
        left[0] = 0
        live = np.flatnonzero(self.shared > 0)
        while len(live):
            live = live[shared[left[live]] > shared[live]]
            left[live] = left[left[live]]
        live = np.flatnonzero(self.shared > 0)
        while len(live):
            live = live[shared[right[live]] >= shared[live]]
            right[live] = right[right[live]]
        return left, right


def last_squares(array: SuffixArray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) of all squares of period q at i whose last word, and not the next, keeps the period.

    ``longest``: the longest period of interest at each position. Only intervals of LEAST_POWER or
    more suffixes are looked at, because the periods of a run all start with the same words.
    """
    shared = array.shared
    most = longest[array.order]
    padded = np.concatenate([[-1, -1], shared, [-1, -1]])
    near = [padded[2 + o : 2 + o + len(shared)] >= shared for o in (-2, -1, 1, 2)]
    wide = (near[0] & near[1]) | (near[1] & near[2]) | (near[2] & near[3])
    nodes = np.flatnonzero((shared > 0) & (shared <= most) & wide)
    empty = np.zeros(0, dtype=np.int64)
    if not len(nodes):
        return empty, empty
    left, right = array.sides()
    lo, hi = left[nodes], right[nodes]
    small_left = nodes - lo <= hi - nodes
    start, stop = np.where(small_left, lo, nodes), np.where(small_left, nodes, hi)
    other, end = np.where(small_left, nodes, lo), np.where(small_left, hi, nodes)
    sizes = stop - start
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK, sizes.sum() + CHUNK, CHUNK), "left") + 1
    found = []
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        size = sizes[a:b]
        node = np.repeat(np.arange(a, min(b, len(nodes))), size)
        at = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + start[node]
        i, q = array.order[at], shared[nodes[node]]
        for first, partner in ((i, i + q), (i - q, i - q)):
            there = (partner >= 0) & (partner < len(shared))
            place = array.inverse[np.where(there, partner, 0)]
            hit = there & (place >= other[node]) & (place < end[node])
            found.append((first[hit], q[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _start(words: np.ndarray, i: int, q: int, least: int) -> int:
    """The square of period q at i rotated to the left while the word that enters equals the one that leaves."""
    step = max(64, 2 * q)
    while i > least:
        lo = max(least, i - step)
        broken = np.flatnonzero(words[lo:i] != words[lo + q : i + q])
        if len(broken):
            return lo + int(broken[-1]) + 1
        i, step = lo, 2 * step
    return least


def block_runs(texts: list[list[int]]) -> dict[int, list[Run]]:
    """Runs (start, length, period) by start and period of the texts that have any."""
    texts = {t: ws for t, ws in enumerate(texts) if len(ws) >= MOST_SHORT}
    if not texts:
        return {}
    sizes = np.array([len(ws) for ws in texts.values()])
    ends = np.cumsum(sizes + 1) - 1
    words = np.zeros(ends[-1] + 1, dtype=np.int64)
    inside = np.ones(len(words), dtype=bool)
    inside[ends] = False
    words[inside] = np.concatenate([np.asarray(ws, dtype=np.int64) for ws in texts.values()])
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    longest = sizes // LEAST_POWER
    i, q = last_squares(SuffixArray(words, text, longest + 1), longest[text])
    begin = ends - sizes
    # A run reaches LEAST_POWER periods back from its end; most squares fail within a few words.
    least = np.maximum(LEAST_POWER * q, MOST_SHORT) - 2 * q
    live = np.flatnonzero(i - least >= begin[text[i]])
    for back in range(1, 9):
        far = back > least[live]
        live = live[far | (words[i[live] - np.where(far, 0, back)] == words[i[live] - np.where(far, 0, back) + np.where(far, 0, q[live])])]
    i, q = i[live], q[live]
    by_end: dict[int, list[Run]] = defaultdict(list)
    turn = np.lexsort((q, i + 2 * q))
    for at, period in zip(i[turn].tolist(), q[turn].tolist(), strict=True):
        end = at + 2 * period
        held = by_end[end]
        if any(period % p == 0 and s <= at for s, _, p in held):
            continue
        start = _start(words, at, period, int(begin[text[at]]))
        if end - start >= max(MOST_SHORT, LEAST_POWER * period):
            held.append((start, end - start, period))
    names = list(texts)
    out: dict[int, list[Run]] = defaultdict(list)
    for held in by_end.values():
        for start, length, period in held:
            t = int(text[start])
            out[names[t]].append((start - int(begin[t]), length, period))
    return {t: sorted(runs, key=lambda r: (r[0], r[2])) for t, runs in out.items()}


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by a space, without those that a run repeats."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period in words), collapsed.

    ``runs`` is ordered by start and period; ``collapsed`` is the words joined by one space, a run's
    words after its first period left out. A null or empty text has no words, no runs and an empty
    ``collapsed``; a null doc_id stays null; repeated rows are found alike; an empty table gives no
    rows. A text is worked on whole, however long, with memory in proportion to it. Columns other than
    doc_id and text are not read.
    """
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        found = block_runs([[numbers[w] for w in ws] for ws in texts])
        runs = [found.get(t, []) for t in range(len(texts))]
        listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
        out = [collapsed(ws, rs) for ws, rs in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(ws) for ws in texts], pa.int64()),
                pa.array(listed, pa.list_(run)),
                pa.array(out, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for given in batches:
            for part in slices(given, "text"):
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), column_bytes(part.column("text")), strict=True):
                    # Bytes are split at the space and the five controls after the tab and before it.
                    words = (raw or b"").split()
                    if texts and held + len(words) > BLOCK_WORDS:
                        yield block(ids, texts)
                        ids, texts, held = [], [], 0
                    ids.append(doc_id)
                    texts.append(words)
                    held += len(words)
        if texts:
            yield block(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def repeated_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of the texts made periodic from some word on.

    With h the crc32 of the decimal doc_id and g = floor(h / 10): where 10 divides h, word i >= a of
    the n words is word a + (i - a) mod p, for a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)).
    Texts without words and rows without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ws = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = (h % 10 == 0) & (F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]")) > 0)
    picked = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(some, ws).alias("_w"))
    n = F.size("_w")
    cut = picked.withColumn("_a", F.when(F.col("_w").isNotNull(), F.col("_g") % n).cast("int"))
    period = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    rest = n - F.col("_a")
    times = F.ceil(rest / period).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, period), times)), 1, rest)
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), again), " ")
    return cut.select("doc_id", F.when(F.col("_w").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
