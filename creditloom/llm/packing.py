"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of ``l`` tokens belongs to class ``k = capacity // l``, and a sequence of class k holds k
pieces, whatever their exact lengths: they fit, because none is longer than capacity / k. Documents
are cut where that saves padding, into pieces of exactly ``capacity // k`` tokens, and the rest stays
whole once its class wastes next to nothing. So every worker fills sequences on its own, with one open
sequence per class as its only state.

What a worker leaves open, less than a sequence per class, goes on to a next round in which a worker
takes the open sequences of FAN_IN others and fills them by the same rule. The last round has one
worker; what it leaves open is packed by length alone, first fit from the longest. A round's input is
bounded by classes and not by documents, so neither a worker nor the driver holds the corpus.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, kept_in_store, slices

CAPACITY = 2048
END = 1
#: Cuts are made at capacity / 2 .. capacity / MOST_CLASS; shorter rests are never cut.
MOST_CLASS = 32
#: A rest stays whole where that wastes no more than this part of the document, or one token.
WASTE = 256
FAN_IN = 8
BATCH_BYTES = 4 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task long"
_NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "task")
_TYPES = (*[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 4)
#: Splitting rule of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level files write a byte as the letter of that number, unprintable ones as 256, 257, ..."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(tokenizer_json: str) -> Callable[[str], list[int]]:
    """Token ids of a text by a tokenizer file of the ``tokenizers`` library, without added specials.

    A byte-level file whose ids follow its merges gives the same ids, several times faster, as ranks;
    texts that name an added token, and all other files, go through the library itself.
    """
    import tokenizers

    slow = tokenizers.Tokenizer.from_str(tokenizer_json)
    spec = json.loads(tokenizer_json)
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    order = [model["vocab"].get(m, -1) for m in merged]
    if not (model["type"] == "BPE" and plain and not spec["normalizer"] and order == sorted(order) and order[:1] >= [256]):
        return lambda text: slow.encode(text, add_special_tokens=False).ids

    import tiktoken

    letters = _byte_of_letter()
    added = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document, in order: whole sequences, exact parts, a rest."""
    pieces = [capacity] * (tokens // capacity)
    rest, waste = tokens % capacity, 1 + min(tokens, capacity) // WASTE
    while rest:
        part = capacity // (capacity // (rest + 1) + 1)
        if rest * MOST_CLASS < capacity or capacity // (capacity // rest) - rest <= waste:
            part = rest
        pieces.append(part)
        rest -= part
    return pieces


class Bins:
    """Open sequences by class. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next_id, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = {}

    def _closed(self, pieces: list[tuple]) -> list[tuple]:
        offset, out = 0, []
        for piece in pieces:
            out.append((*piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """The placed pieces of the sequence that this one completes, if it does."""
        kind = self.capacity // piece[2]
        held = self.open.setdefault(kind, [])
        held.append(piece)
        return self._closed(self.open.pop(kind)) if len(held) == kind else []

    def left(self) -> list[tuple]:
        """Pieces of open sequences, not placed."""
        return [(*p, None, None) for kind in sorted(self.open) for p in self.open[kind]]

    def rest(self) -> Iterator[list[tuple]]:
        """The open pieces placed by length alone, first fit from the longest."""
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        bins: list[list[tuple]] = []
        room: list[int] = []
        for piece in pieces:
            at = next((i for i, r in enumerate(room) if r >= piece[2]), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[at].append(piece)
            room[at] -= piece[2]
        for held in bins:
            yield self._closed(held)


def _batches(rows: Iterator[list[tuple]], task: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = [*zip(*held, strict=True), [task] * len(held)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    for placed in rows:
        held += placed
        size += sum(len(p[3]) + 64 for p in placed)
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _first_id(step: int, task: int) -> int:
    return (step << 56) + (task << 32)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their place: each document's ids and then ``end``, each in one piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids (unsigned 32-bit,
    little-endian), doc_tokens (of the document, with ``end``), sequence_id, offset (in the sequence).
    A null or empty text is ``end`` alone; a null doc_id stays null, repeated rows are packed
    each; a text of any length is cut like any other; an empty table gives no rows. Equal lengths are
    placed in the order they are met. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    # Every worker needs the file; its size is the vocabulary's and not the data's.
    shipped = spark.sparkContext.broadcast(tokenizer_json)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(shipped.value), TaskContext.get().partitionId()
        bins = Bins(_first_id(0, task), capacity)

        def placed() -> Iterator[list[tuple]]:
            for given in batches:
                for part in slices(given, "text"):
                    ids = part.column("doc_id").to_pylist()
                    for doc_id, raw in zip(ids, column_bytes(part.column("text")), strict=True):
                        found = array("I", encode((raw or b"").decode("utf-8", "replace")))
                        found.append(end)
                        data, start = memoryview(found).cast("B"), 0
                        for length in cut(len(found), capacity):
                            body = bytes(data[4 * start : 4 * (start + length)])
                            yield bins.add((doc_id, start, length, body, len(found)))
                            start += length
            yield bins.left()

        yield from _batches(placed(), task)

    def merge(step: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in _NAMES], strict=True))
            first_row = next(rows, None)
            if first_row is None:
                return
            # Groups that meet in one task are one worker, by the number of any of them.
            task = first_row[-1]
            bins = Bins(_first_id(step, task), capacity)

            def placed() -> Iterator[list[tuple]]:
                for row in chain([first_row], rows):
                    yield bins.add(row[:5])
                yield from bins.rest() if last else [bins.left()]

            yield from _batches(placed(), task)

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = kept_in_store(rows.mapInArrow(first, PIECES), "packed-0")
    done = [packed.where("sequence_id is not null")]
    for step in range(1, 64):
        left = packed.where("sequence_id is null")
        workers = left.agg(F.max("task")).first()[0]
        if workers is None:
            break
        groups = workers // FAN_IN + 1
        dealt = left.withColumn("task", F.floor(F.col("task") / FAN_IN)).repartition(groups, "task")
        packed = kept_in_store(dealt.mapInArrow(merge(step, groups == 1), PIECES), f"packed-{step}")
        done.append(packed.where("sequence_id is not null"))
        if groups == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("task")
