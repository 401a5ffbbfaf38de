"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets a leading space, spaces become U+2581, and the most likely sequence of pieces is found
by the sum of their log scores. A character that no piece covers is spelled in byte pieces. Decoding
joins the pieces, reads runs of byte pieces as UTF-8 and turns the markers back into spaces.

No piece has a marker after another character, so the best sequence of a text is that of its
stretches between markers put together. A task encodes each distinct stretch once, all new ones of a
part at a time in numpy. A vocabulary for which that does not hold is encoded in whole texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
#: What an uncovered character costs below the least likely piece.
UNKNOWN_COST = 10.0
#: Distinct stretches that a task remembers.
KNOWN_STRETCHES = 250_000


@dataclass
class Vocabulary:
    """Pieces by id, their scores and kinds, and the ids of the 256 byte pieces (-1: none)."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray

    @classmethod
    def read(cls, model: bytes, rank_offset: float = 2.7) -> Vocabulary:
        """From a model file. Files of other kinds than unigram hold ranks and not log scores; their
        pieces get the log probabilities of Zipf's law over the ranks."""
        from sentencepiece import sentencepiece_model_pb2

        parsed = sentencepiece_model_pb2.ModelProto()
        parsed.ParseFromString(model)
        pieces = [p.piece for p in parsed.pieces]
        kinds = np.array([p.type for p in parsed.pieces])
        scores = np.array([p.score for p in parsed.pieces], dtype=np.float64)
        if parsed.trainer_spec.model_type != UNIGRAM:
            normal = np.flatnonzero(kinds == NORMAL)
            ranks = np.empty(len(normal))
            ranks[np.argsort(-scores[normal], kind="stable")] = np.arange(len(normal))
            shares = 1 / (ranks + rank_offset)
            scores[normal] = np.log(shares / shares.sum())
        return cls(pieces, scores.astype(np.float32), kinds)


class Encoder:
    """Double-array trie of a vocabulary's pieces, and what is needed to walk it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        usable = [i for i, k in enumerate(v.kinds.tolist()) if k in (NORMAL, USER) and v.pieces[i]]
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i in np.flatnonzero(v.kinds == BYTE).tolist():
            self.byte_ids[int(v.pieces[i][1:-1], 16)] = i
        found = np.flatnonzero(v.kinds == UNKNOWN)
        self.unknown = int(found[0]) if len(found) else 0
        self.unknown_score = np.float32((v.scores[usable].min() if usable else 0) - UNKNOWN_COST)
        self.longest = max((len(v.pieces[i].encode()) for i in usable), default=0)
        self.splits = not any(MARK in v.pieces[i].lstrip(MARK) for i in usable)
        lines = "" if any("\n" in v.pieces[i] for i in usable) else "\n"
        self.stretch = re.compile(rf"{MARK}*[^{MARK}{lines}]+|{MARK}+" + (f"|{lines}" if lines else ""))
        self._build({v.pieces[i].encode(): i for i in usable})
        kinds = v.kinds.tolist()
        # Pieces that decode to nothing, and byte pieces as bytes of their own.
        self.decoded = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(v.pieces, kinds, strict=True)
        ]

    def _build(self, ids: dict[bytes, int]) -> None:
        """Child of node n by byte b is base[n] + b, if check there says n. Node 0 is the root."""
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for piece, number in ids.items():
            node = 0
            for byte in piece:
                node_next = children[node].get(byte)
                if node_next is None:
                    node_next = len(children)
                    children[node][byte] = node_next
                    children.append({})
                    value.append(-1)
                node = node_next
            value[node] = number
        # Nodes of several children are placed front to back, single children into what they leave free.
        size = 4 * len(children) + 2048
        base, check, final, used = [0] * size, [-1] * size, [-1] * size, bytearray(size)
        check[0], used[0] = 0, 1
        front, free, waiting = 1, 1, [(0, 0)]
        while waiting:
            node, slot = waiting.pop()
            final[slot] = value[node]
            keys = sorted(children[node])
            if not keys:
                continue
            if len(keys) == 1:
                free = max(free, keys[0] + 1)
                while used[free]:
                    free += 1
                start = free - keys[0]
            else:
                start = front
                while any(used[start + k] for k in keys):
                    start += 1
                front = start
            grow = max(front, free) + 1024 - len(used)
            if grow > 0:
                base += [0] * grow
                check += [-1] * grow
                final += [-1] * grow
                used += bytes(grow)
            base[slot] = start
            for key in keys:
                used[start + key] = 1
                check[start + key] = slot
                waiting.append((children[node][key], start + key))
        base, check, final = (np.array(x, dtype=np.int32) for x in (base, check, final))
        self.base, self.check, self.final = base, check, final

    def viterbi(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, and how many each has. All stretches advance together."""
        sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, dtype=np.int64), np.zeros(len(stretches), dtype=np.int64)
        symbols = np.frombuffer(b"".join(stretches), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        stop = np.repeat(ends, sizes)
        # Characters begin where no continuation byte is; each ends where the next begins.
        heads = np.flatnonzero((symbols & 0xC0) != 0x80)
        width = np.diff(np.append(heads, total))
        at, node = heads, np.zeros(len(heads), dtype=np.int64)
        covered = np.zeros(total, dtype=bool)
        next_head = np.empty(total, dtype=np.int64)
        next_head[heads] = heads + width
        found = []
        for step in range(self.longest):
            inside = at + step < stop[at]
            at, node = at[inside], node[inside]
            slot = self.base[node] + symbols[at + step]
            slot = np.minimum(slot, len(self.check) - 1)
            real = (self.check[slot] == node) & (slot != 0)
            at, node = at[real], slot[real].astype(np.int64)
            if not len(at):
                break
            piece = self.final[node]
            hit = piece >= 0
            found.append((at[hit], at[hit] + step + 1, piece[hit].astype(np.int64)))
            covered[at[hit & (at + step + 1 == next_head[at])]] = True
        bare = heads[~covered[heads]]
        found.append((bare, next_head[bare], np.full(len(bare), -1, dtype=np.int64)))
        source, target, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        score = np.where(piece >= 0, self.vocabulary.scores[piece], self.unknown_score).astype(np.float32)
        # By place in the stretch: what leads to a place is complete before anything leaves it.
        place = source - np.repeat(begins, sizes)[source]
        order = np.argsort(place, kind="stable")
        source, target, piece, score, place = (x[order] for x in (source, target, piece, score, place))
        # The value of position p is held at p + stretch number, so that ends and next starts differ.
        row = np.repeat(np.arange(len(stretches)), sizes)
        shift = row[source]
        source, target = source + shift, target + shift
        best = np.full(total + len(stretches), -np.inf, dtype=np.float32)
        best[begins + np.arange(len(stretches))] = 0
        came = np.zeros(len(best), dtype=np.int64)
        took = np.zeros(len(best), dtype=np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s, t = source[lo:hi], target[lo:hi]
            candidate = best[s] + score[lo:hi]
            better = candidate > best[t]
            t = t[better]
            best[t], came[t], took[t] = candidate[better], s[better], piece[lo:hi][better]
        owners, chosen, spans = [], [], []
        rows = np.arange(len(stretches))
        now, first = ends + rows, begins + rows
        while True:
            alive = now > first
            rows, now, first = rows[alive], now[alive], first[alive]
            if not len(rows):
                break
            owners.append(rows)
            chosen.append(took[now])
            spans.append((came[now] - rows, now - rows))
            now = came[now]
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(chosen[::-1])
        left, right = (np.concatenate([x[i] for x in spans[::-1]]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        owner, ids, left, right = owner[order], ids[order], left[order], right[order]
        if (ids < 0).any():
            ids, owner = self._spelled(ids, owner, left, right, symbols)
        return ids, np.bincount(owner, minlength=len(stretches))

    def _spelled(self, ids, owner, left, right, symbols) -> tuple[np.ndarray, np.ndarray]:
        """Uncovered characters as byte pieces, or as the unknown piece if there are none."""
        bare = ids < 0
        if (self.byte_ids < 0).any():
            return np.where(bare, self.unknown, ids), owner
        times = np.where(bare, right - left, 1)
        starts = np.cumsum(times) - times
        within = np.arange(times.sum()) - np.repeat(starts, times)
        spelled = self.byte_ids[symbols[np.minimum(np.repeat(left, times) + within, len(symbols) - 1)]]
        return np.where(np.repeat(bare, times), spelled, np.repeat(ids, times)), np.repeat(owner, times)

    def state(self) -> dict:
        """Plain values, for broadcasting to workers that lack this module."""
        v = self.vocabulary
        return {**self.__dict__, "vocabulary": (v.pieces, v.scores, v.kinds)}

    @classmethod
    def of_state(cls, state: dict) -> Encoder:
        encoder = cls.__new__(cls)
        encoder.__dict__.update(state)
        encoder.vocabulary = Vocabulary(*state["vocabulary"])
        return encoder

    def stretches(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.stretch.findall(marked) if self.splits else [marked]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class TaskEncoder:
    """Encodes the texts of a task, every distinct stretch once until they are too many to remember."""

    def __init__(self, encoder: Encoder, most: int = KNOWN_STRETCHES):
        self.encoder, self.most = encoder, most
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.numbers) > self.most:
            self._forget()
        number, coded, lengths = self.numbers.__getitem__, [], []
        for text in texts:
            parts = self.encoder.stretches(text)
            coded.extend(map(number, parts))
            lengths.append(len(parts))
        new = list(islice(self.numbers, len(self.sizes), None))
        # Long stretches apart, so that short ones do not wait for them.
        if new:
            raw = [s.encode("utf-8", "replace") for s in new]
            size = np.array([len(r) for r in raw])
            sizes, pieces = np.zeros(len(raw), dtype=np.int64), []
            order = np.argsort(size, kind="stable")
            cuts = np.append(np.searchsorted(size[order], [0, 8, 14, 24, 64, 512]), len(raw))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, 20_000):
                    chosen = order[at : min(hi, at + 20_000)]
                    ids, counts = self.encoder.viterbi([raw[i] for i in chosen])
                    sizes[chosen] = counts
                    pieces.append(ids.astype(np.int32))
            starts = np.empty(len(raw), dtype=np.int64)
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            self.starts = np.concatenate([self.starts, starts + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, *pieces])
        coded = np.array(coded, dtype=np.int64)
        sizes = self.sizes[coded]
        totals = np.cumsum(sizes)
        at = np.arange(totals[-1] if len(totals) else 0) + np.repeat(self.starts[coded] - (totals - sizes), sizes)
        ends = np.append(0, totals)[np.cumsum([0, *lengths])]
        return self.ids[at], np.diff(ends)


def load_encoder(path: str) -> Encoder:
    with open(path, "rb") as file:
        return Encoder(Vocabulary.read(file.read()))


def encode_documents(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """All columns but the text, and token_ids, n_tokens, n_byte_tokens, round_trip.

    round_trip: the ids decode to the text again, which fails only for texts that hold the marker
    itself. A null or empty text has no tokens; a null one decodes to the empty text, so its
    round_trip is false. Columns of the names added here are replaced; repeated rows stay.
    """
    added = ["token_ids", "n_tokens", "n_byte_tokens", "round_trip"]
    rows = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    kept = [c for c in rows.columns if c != "text"]
    model = docs.sparkSession.sparkContext.broadcast(encoder.state())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = TaskEncoder(Encoder.of_state(model.value))
        byte_piece = local.encoder.vocabulary.kinds == BYTE
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                given = [x.decode("utf-8", "replace") if x is not None else None for x in column_bytes(batch.column("text"))]
                ids, sizes = local.encode([t or "" for t in given])
                ends = np.cumsum(sizes)
                spelled = np.append(0, np.cumsum(byte_piece[ids]))
                plain = ids.tolist()
                same = [
                    t is not None and local.encoder.decode(plain[e - n : e]) == t
                    for t, e, n in zip(given, ends.tolist(), sizes.tolist(), strict=True)
                ]
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in kept],
                        pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                        pa.array(sizes),
                        pa.array(spelled[ends] - spelled[ends - sizes]),
                        pa.array(same, pa.bool_()),
                    ],
                    [*kept, *added],
                )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(encode, f"{types}, token_ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, encoder: Encoder) -> DataFrame:
    """All columns, and ``text`` decoded from token_ids; null ids give a null text."""
    rows = encoded.drop("text")
    model = encoded.sparkSession.sparkContext.broadcast(encoder.state())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Encoder.of_state(model.value)
        for batch in batches:
            texts = [None if ids is None else local.decode(ids) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(decode, f"{types}, text string")
