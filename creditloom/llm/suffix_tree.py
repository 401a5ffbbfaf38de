"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its lower-cased words, each with a space after it, and an end mark. The tree's contexts are
the strings of up to DEPTH symbols before a symbol. Contexts of up to HEAD symbols are all retained; a
longer one is retained if it was seen LEAST_COUNT times and its next-symbol distribution diverges from
that of the context one symbol shorter by enough to matter: LEAST_GAIN bits over all its positions.
Both are absolute, so the tree grows with the corpus. A context's distribution is smoothed with the
shorter context's, which weighs as many occurrences as the context has different next symbols (and
LEAST_SMOOTHING more). A symbol is predicted by the longest retained suffix of what precedes it. A token's
probability is a mixture: TREE_SHARE of what the tree gives to its symbols, one by one, and the rest of
its share of all tokens learned from. A token that was not learned has the tree's part alone, so it is
as likely as its spelling.

The corpus is counted in full, in Spark, and the tree stays there: its longer contexts lie in buckets by
their last symbols, so that a bucket holds every context with all its shorter ones. A block of documents
asks the buckets for the grams that occur in it and gets their probabilities. Only the counts of symbols
after up to HEAD others reach the driver; they are bounded by the alphabet, and none is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, held_out, kept_in_store, slices, text_of

DEPTH, HEAD = 5, 2
LEAST_COUNT, LEAST_GAIN = 4, 16.0
LEAST_SMOOTHING = 0.5
TREE_SHARE = 0.85
FOLDS = 10
#: A byte that no UTF-8 text has: the end mark, and what stands before a text.
END = 0xFF
BLOCK_BYTES = 8 << 20
MOST_WORDS, MOST_GRAMS = 300_000, 2_000_000
#: Buckets of longer contexts: at least so many, and one for so many blocks.
LEAST_BUCKETS, BUCKET_BLOCKS = 128, 4


def normal(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many texts, each with DEPTH marks before and an end mark after it, and their starts."""
    before = bytes([END]) * DEPTH
    parts = [before + b" ".join([*words, b"\xff"]) for words in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes


def coded(symbols: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Code of each symbol from the first text's on: the symbol (low byte) with the ``depth`` before it."""
    code = symbols.astype(np.int64)
    codes = code[DEPTH:].copy()
    for back in range(1, depth + 1):
        codes |= code[DEPTH - back : len(code) - back] << (8 * back)
    return codes


def grams(symbols: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and counts of a symbol (low byte) with the ``depth`` symbols before it."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = coded(symbols, depth)
    real = np.ones(len(codes), dtype=bool)
    # The marks before a text are context only.
    at = (starts[1:, None] - DEPTH + np.arange(DEPTH)[None, :]).ravel()
    real[at] = False
    codes = np.sort(codes[real])
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def count_grams(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, n) over all texts, a code with ``depth`` symbols before its own; every task combines its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for whole in batches:
            for batch in slices(whole, "text"):
                held.append(grams(*stream([normal(t) for t in column_bytes(batch.column("text"))]), depth))
                if len(held) > 3:
                    held = [_merged(held)]
        if held:
            codes, counts = _merged(held)
            for at in range(0, len(codes), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(counts[part])], ["code", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


Level = tuple[np.ndarray, np.ndarray]


def _low(codes: np.ndarray, symbols: int) -> np.ndarray:
    return codes & ((1 << (8 * symbols)) - 1)


def _places(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted one is in the sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def retained(levels: list[Level], least_count: float, least_gain: float) -> list[tuple[np.ndarray, ...]]:
    """Of each level: its contexts, their counts, which are retained, each code's context, next symbols of each.

    ``levels[k]``: sorted codes of a symbol after k context symbols, and their counts.
    """
    found = []
    for k, (codes, counts) in enumerate(levels):
        names, rows = np.unique(codes >> 8, return_inverse=True)
        sums = np.bincount(rows, counts, minlength=len(names))
        kept = np.ones(len(names), dtype=bool)
        if k > HEAD:
            at = np.searchsorted(levels[k - 1][0], _low(codes, k))
            p = counts / sums[rows]
            _, shorter_sums, _, shorter_rows, _ = found[k - 1]
            q = levels[k - 1][1][at] / shorter_sums[shorter_rows[at]]
            divergence = np.bincount(rows, p * np.log2(p / q), minlength=len(names))
            kept = (sums >= least_count) & (divergence * sums >= least_gain)
        found.append((names, sums, kept, rows, np.bincount(rows, minlength=len(names))))
    # A retained context needs the shorter ones it is smoothed with.
    for k in range(len(levels) - 1, HEAD + 1, -1):
        names, _, kept, _, _ = found[k]
        found[k - 1][2][np.searchsorted(found[k - 1][0], _low(names[kept], k - 1))] = True
    return found


def gram_logs(
    codes: np.ndarray, counts: np.ndarray, head: list[Level], least_count: float = LEAST_COUNT, least_gain: float = LEAST_GAIN
) -> np.ndarray:
    """log10 probability that the tree gives to the low byte of each sorted code after the rest of it.

    ``counts``: how often each was learned, 0 if it was only asked for. ``codes`` hold all that was
    learned after the last HEAD + 1 context symbols of any of them. ``head``: levels up to HEAD.
    """
    learned = counts > 0
    own = codes[learned], counts[learned]
    levels = [*head, *(_merged([(_low(own[0], k + 1), own[1])]) for k in range(HEAD + 1, DEPTH + 1))]

    def seen(k: int) -> np.ndarray:
        at, there = _places(levels[k][0], _low(codes, k + 1))
        return np.where(there, levels[k][1][at], 0) if len(levels[k][0]) else np.zeros(len(codes))

    p = (seen(0) + 0.5) / (levels[0][1].sum() + 128)
    for k, (names, sums, kept, _, distinct) in enumerate(retained(levels, least_count, least_gain)):
        names, sums, weight = names[kept], sums[kept], distinct[kept] + LEAST_SMOOTHING
        if k and len(names):
            at, there = _places(names, _low(codes >> 8, k))
            p = np.where(there, (seen(k) + weight[at] * p) / (sums[at] + weight[at]), p)
    return np.log10(p)


def _levels(found: pa.Table, depth: int) -> list[Level]:
    """Sorted codes and counts after 0 to ``depth`` context symbols, from those after ``depth``."""
    code, n = (found.column(c).to_numpy() for c in ("code", "n"))
    return [_merged([(_low(code, k + 1), n)]) for k in range(depth + 1)]


def _totals(root: Level) -> tuple[int, int]:
    """Tokens and texts by the counts of the single symbols."""
    symbols = dict(zip(*(x.tolist() for x in root), strict=True))
    n_texts = symbols.get(END, 0)
    return symbols.get(0x20, 0) + n_texts, n_texts


def _packed(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed differences."""
    return pa.compress(np.diff(codes, prepend=np.int64(0)).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(packed, 8 * size, "zstd", asbytes=True), dtype=np.int64))


def _bucket(codes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each code by its last HEAD + 1 context symbols, which all longer contexts keep."""
    key = _low(codes >> 8, HEAD + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(by)
    return ((key >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)


def grams_of_blocks(blocked: DataFrame, n_buckets: int) -> DataFrame:
    """What each block asks of each bucket: the distinct codes in it, and how often it teaches each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Level]] = {}

        def flush():
            for number, parts in held.items():
                codes, counts = _merged(parts)
                bucket = _bucket(codes, n_buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
                given = [(i, x) for i, x in enumerate(np.split(order, ends[:-1])) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(given), pa.int32()),
                        pa.array([i for i, _ in given], pa.int32()),
                        pa.array([len(x) for _, x in given], pa.int32()),
                        pa.array([_packed(codes[x]) for _, x in given], pa.binary()),
                        pa.array([pa.compress(counts[x].tobytes(), "zstd", asbytes=True) for _, x in given], pa.binary()),
                    ],
                    ["block", "bucket", "size", "codes", "counts"],
                )
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                numbers, apart = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "held_out"))
                texts = column_bytes(batch.column("text"))
                for number in np.unique(numbers):
                    parts = held.setdefault(int(number), [])
                    for out in (False, True):
                        mine = np.flatnonzero((numbers == number) & (apart == out))
                        codes, counts = grams(*stream([normal(texts[i]) for i in mine]))
                        parts.append((codes, counts * (not out)))
                    if len(parts) > 6:
                        held[int(number)] = [_merged(parts)]
                if sum(len(p[0]) for parts in held.values() for p in parts) > MOST_GRAMS:
                    yield from flush()
        yield from flush()

    return blocked.mapInArrow(ask, "block int, bucket int, size int, codes binary, counts binary")


def answered(asked: DataFrame, head: list[Level], least_count: float, least_gain: float) -> DataFrame:
    """(block, size, codes, logs): the tree's log10 probability of every code asked for, by bucket."""
    model = asked.sparkSession.sparkContext.broadcast(head)

    def answer(rows: pa.Table) -> pa.Table:
        sizes = rows.column("size").to_pylist()
        each = [_unpacked(c, n) for c, n in zip(rows.column("codes").to_pylist(), sizes, strict=True)]
        counts = [
            np.frombuffer(pa.decompress(c, 8 * n, "zstd", asbytes=True), dtype=np.int64)
            for c, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)
        ]
        codes, counts = _merged(list(zip(each, counts, strict=True)))
        logs = gram_logs(codes, counts, model.value, least_count, least_gain).astype(np.float32)
        given = [logs[np.searchsorted(codes, x)].tobytes() for x in each]
        columns = {c: rows.column(c) for c in ("block", "size", "codes")}
        return pa.table(columns | {"logs": pa.array(given, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "block int, size int, codes binary, logs binary")


def stream_logs(symbols: np.ndarray, starts: np.ndarray, codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log10 probability of each token of a stream by those of its grams, the end marks included."""
    found = pa.array(coded(symbols)).dictionary_encode()
    at, _ = _places(codes, found.dictionary.to_numpy())
    flat = np.zeros(len(symbols))
    flat[DEPTH:] = logs[at].take(found.indices.to_numpy())
    begins = np.sort(np.concatenate([starts + DEPTH, np.flatnonzero(symbols == 0x20) + 1]))
    flat[(starts[:, None] + np.arange(DEPTH)[None, :]).ravel()] = 0
    return np.add.reduceat(flat, begins)


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, block_distinct long"
)


def score_texts(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, least_count: float = LEAST_COUNT, least_gain: float = LEAST_GAIN
) -> DataFrame:
    """Unigram base and tree score of every document, both learned from those not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A document is held
    out if crc32 of its doc_id as text is a multiple of FOLDS; one without a doc_id is held out. A
    null text counts as empty: its only token is the end. Repeated rows are separate documents.
    Without any document to learn from, every token is new: base probability one, and all symbols alike.
    An empty table gives no rows. A text is scored whole, however long, in parts of some megabytes.

    Word counts are attached by blocks of documents: a block's distinct words are shuffled to the
    counts and back, not its word occurrences, and a word has at most one row or a few per block. The
    tree's probabilities are attached in the same way, packed by block and bucket.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out("doc_id", FOLDS).alias("held_out"),
        text_of().alias("text"),
    )
    head = _levels(count_grams(rows.where("not held_out"), HEAD).toArrow(), HEAD)
    n_train, n_texts = _totals(head[0])
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    blocked = rows.withColumn("block", block).repartition(n_blocks, "block")

    def words_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}

        def flush():
            for number, counter in counts.items():
                words, n = list(counter), list(counter.values())
                for at in range(0, len(words), 1 << 17):
                    part = slice(at, at + (1 << 17))
                    size = len(words[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * size, pa.int32()), pa.array(words[part], pa.binary()), pa.array(n[part], pa.int64())],
                        ["block", "word", "n"],
                    )
            counts.clear()

        for batch in batches:
            columns = (batch.column("block").to_pylist(), batch.column("held_out").to_pylist())
            for number, held, text in zip(*columns, column_bytes(batch.column("text")), strict=True):
                words = normal(text)
                counter = counts.setdefault(number, Counter())
                counter.update(dict.fromkeys(words, 0) if held else words)
            if sum(map(len, counts.values())) > MOST_WORDS:
                yield from flush()
        yield from flush()

    listed = blocked.mapInArrow(words_of_blocks, "block int, word binary, n long")
    same = Window.partitionBy("word")
    known = listed.select(
        "block",
        "word",
        F.sum("n").over(same).alias("c"),
        (F.row_number().over(same.orderBy("block", "n")) == 1).alias("once"),
    )
    asked = grams_of_blocks(blocked, max(LEAST_BUCKETS, n_blocks // BUCKET_BLOCKS))
    attached = known.unionByName(answered(asked, head, least_count, least_gain), allowMissingColumns=True)

    def score_block(texts: pa.Table, attached: pa.Table) -> pa.Table:
        by_tree_rows = pc.is_valid(attached.column("codes"))
        words, tree = attached.filter(pc.invert(by_tree_rows)), attached.filter(by_tree_rows)
        answers = zip(*(tree.column(x).to_pylist() for x in ("codes", "size", "logs")), strict=True)
        parts = [(_unpacked(x, n), np.frombuffer(y, dtype=np.float32)) for x, n, y in answers]
        codes, logs = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        c = words.column("c").to_numpy()
        counts = dict(zip(words.column("word").to_pylist(), c.tolist(), strict=True))
        counts[b"\xff"] = n_texts
        once = words.column("once").to_numpy()
        distinct = int((c[once.astype(bool)] > 0).sum())
        given = [normal(t) for chunk in texts.column("text").chunks for t in column_bytes(chunk)]
        columns: list[list[np.ndarray]] = [[], [], [], []]
        at = 0
        while at < len(given):
            stop, symbols = at, 0
            while stop < len(given) and (stop == at or symbols < 2 << 20):
                symbols += sum(map(len, given[stop])) + len(given[stop])
                stop += 1
            part = given[at:stop]
            sizes = np.array([len(w) + 1 for w in part])
            firsts = np.cumsum(sizes) - sizes
            flat = chain.from_iterable([*w, b"\xff"] for w in part)
            known = np.fromiter(map(counts.__getitem__, flat), np.float64, sizes.sum())
            by_tree = stream_logs(*stream(part), codes, logs)
            with np.errstate(divide="ignore"):
                by_share = np.log10(known * (1 - TREE_SHARE) / max(1, n_train))
            most = np.maximum(by_tree + np.log10(TREE_SHARE), by_share)
            least = np.minimum(by_tree + np.log10(TREE_SHARE), by_share)
            columns[0].append(sizes)
            columns[1].append(np.add.reduceat((known > 0).astype(np.int64), firsts))
            columns[2].append(np.add.reduceat(np.log10(known + 0.1), firsts))
            columns[3].append(np.add.reduceat(most + np.log10(1 + 10.0 ** (least - most)), firsts))
            at = stop
        joined = [np.concatenate(x) if x else np.zeros(0) for x in columns]
        names = ("n_tokens", "n_known", "known_log", "score")
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        out = {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out")}
        out |= {name: pa.array(x, kind) for name, x, kind in zip(names, joined, kinds, strict=True)}
        # A block's share of the distinct words stands in its first row.
        out["block_distinct"] = pa.array([distinct, *[0] * len(given)][: len(given)], pa.int64())
        return pa.table(out)

    scored = blocked.groupBy("block").cogroup(attached.groupBy("block")).applyInArrow(score_block, RESULT)
    scored = kept_in_store(scored, "lm-scores")
    totals = scored.agg(F.coalesce(F.sum("block_distinct"), F.lit(0)).alias("_distinct"))
    distinct = F.col("_distinct") + int(n_texts > 0)
    base = F.col("known_log") - F.col("n_tokens") * F.log10(F.lit(float(n_train)) + 0.1 * (distinct + 1))
    return scored.crossJoin(F.broadcast(totals)).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
