"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Three differing bits change three bytes at most, so
linked fingerprints share at least five of the eight: the guaranteed minimum. The index is over
positional bytes, four positions to a posting list. The fourteen sets of four positions whose
numbers have exclusive-or zero hold every triple of positions exactly once, so whatever three bytes
differ lie in one of them, and the pair meets in the list of the other four. Lists of one position
would hold a 256th of all fingerprints each and their pairs would grow with the square of the table.

Inside a list the shared positional bytes of each pair are tallied, pairs below the minimum are
dropped, and the rest verified bit by bit. A list returns a spanning forest of its links, not its
links: as every link lies in some list, the forests together connect what the links connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, kept_in_store, text_of
from creditloom.llm.components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
COVERS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Fingerprints of one posting list that meet in one task; a longer list is dealt out in tiles.
TILE = 2048


def simhash(text: bytes | None) -> int:
    """Signed 64-bit SimHash of a text's 3-word shingles, zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, HASH_SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [simhash(t) for t in column_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _positional(fp: str, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)


def posting_keys(fp: str) -> list[Column]:
    """The fourteen posting lists of a fingerprint: the set's number, then its four bytes."""
    keys = []
    for number, cover in enumerate(COVERS):
        key = F.lit(number).cast("long")
        for position in cover:
            key = F.shiftleft(key, 8).bitwiseOR(_positional(fp, position))
        keys.append(key)
    return keys


def _link_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of shared positional bytes, count filter, then the exact distance of what is left."""
    linked = np.zeros((len(a), len(b)), dtype=bool)
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        apart = a[at : at + step, None] ^ b[None, :]
        shared = np.zeros(apart.shape, dtype=np.uint8)
        for position in range(8):
            shared += ((apart >> np.uint64(8 * position)) & np.uint64(255)) == 0
        linked[at : at + step] = (shared >= LEAST_BYTES) & (np.bitwise_count(apart) <= MOST_BITS)
    return linked


def _forest(a: np.ndarray, b: np.ndarray | None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest; with ``b`` only links between the two sides count."""
    if b is None:
        links = _link_matrix(a, a)
    else:
        links = np.zeros((len(a) + len(b),) * 2, dtype=bool)
        links[: len(a), len(a) :] = _link_matrix(a, b)
        links |= links.T
    found, waiting = [], np.ones(len(links), dtype=bool)
    for start in range(len(links)):
        if not waiting[start]:
            continue
        waiting[start] = False
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & waiting)
            waiting[front] = False
            found += [(start, int(i)) for i in front]
    return found


def _links_of_group(fps: np.ndarray, nodes: np.ndarray, left: np.ndarray, across: bool) -> list[tuple[int, int]]:
    if across:
        order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
        cut = int(left.sum())
        pairs = _forest(fps[order[:cut]], fps[order[cut:]])
    elif len(fps) == 2:
        apart = int(fps[0]) ^ int(fps[1])
        shared = sum(1 for p in range(8) if not (apart >> (8 * p)) & 255)
        pairs, order = ([(0, 1)] if shared >= LEAST_BYTES and apart.bit_count() <= MOST_BITS else []), np.arange(2)
    else:
        pairs, order = _forest(fps, None), np.arange(len(fps))
    return [(int(nodes[order[i]]), int(nodes[order[j]])) for i, j in pairs]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, a, b), so that each group is contiguous and at most two tiles long."""

    def arrays(batch):
        return [np.asarray(batch.column(c)) for c in ("key", "a", "b", "tile", "fp", "node")]

    def emit(columns):
        key, a, b, tile, fp, node = columns
        same = (key[1:] == key[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(key)]])
        found = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                found += _links_of_group(
                    fp[lo:hi].astype(np.uint64), node[lo:hi], tile[lo:hi] == a[lo], bool(a[lo] != b[lo])
                )
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        key, a, b = now[:3]
        differs = np.flatnonzero((key != key[-1]) | (a != a[-1]) | (b != b[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield emit([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield emit(held)


def links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect all fingerprints within three bits. ``nodes``: (fp, node), fp unique.

    A list longer than a tile is dealt out: its fingerprints are divided into tiles by a digest, and
    every pair of tiles meets in a task of its own. So no task holds more than about two tiles of one
    list, and every pair of the list is still compared.
    """
    posted = nodes.select("fp", "node", F.explode(F.array(*posting_keys("fp"))).alias("key"))
    lengths = posted.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    listed = posted.join(lengths, "key")
    tiles = F.ceil(F.col("_n") / tile)
    own = F.pmod(F.xxhash64("fp"), tiles)
    dealt = (
        listed.withColumn("_tiles", tiles)
        .withColumn("tile", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
        .select("key", F.least("tile", "_other").alias("a"), F.greatest("tile", "_other").alias("b"), "tile", "fp", "node")
    )
    grouped = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return grouped.mapInArrow(_link_batches, "u long, v long")


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents with one fingerprint are one node, named by its smallest doc_id, so copies make no
    pairs. component_id is the smallest doc_id reachable over links of three bits or fewer. Null and
    empty texts have fingerprint zero and link like any other; rows without a doc_id are grouped with
    their fingerprint, and if none of a component has a doc_id its component_id is null. Repeated
    rows come back as often as they are there; an empty table gives no rows.
    """
    prints = kept_in_store(fingerprints(docs), "simhash")
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    # A fingerprint without any doc_id is a node of its own below all ids; the digest keeps it apart.
    nameless = -F.pmod(F.xxhash64("fp"), F.lit(2**62)) - 2**62
    nodes = kept_in_store(named.select("fp", "_least", F.coalesce("_least", nameless).alias("node")), "simhash-nodes")
    grouped = components(links(nodes, tile))
    classes = nodes.join(grouped, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("_root"), "_least"
    )
    lowest = classes.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = classes.join(lowest, "_root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The documents without those that have a near-duplicate of smaller doc_id in their group.

    One document of each group stays, the one with its smallest doc_id. Rows of one doc_id are one
    document, of which one row stays, chosen by a digest of the text. A row without a doc_id cannot
    be told from others like it, so it stays.
    """
    first = (
        near_duplicates(docs, tile)
        .where("doc_id = component_id")
        .select(F.col("doc_id").alias("_id"))
        .distinct()
    )
    keyed = docs.withColumn("_key", F.col("doc_id").cast("long"))
    kept = keyed.where("_key is not null").join(first, F.col("_key") == F.col("_id"), "left_semi")
    order = Window.partitionBy("_key").orderBy(F.xxhash64(text_of()), text_of())
    one = kept.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return one.unionByName(keyed.where("_key is null")).drop("_key")
