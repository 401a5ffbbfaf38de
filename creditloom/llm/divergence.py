"""How the sources of a language differ in the terms they use.

The terms of a language are those in enough of its documents, found by prefix refinement: the bytes of
a term are read up to 1, 2, 4, 8, ... and at each level only prefixes that extend a kept one, and are
themselves in enough documents, are kept. A document counts once for a prefix however many of its
terms begin with it, so no kept term is lost; a term is complete at the longest level it fills, and
then counted itself. Rare terms leave with their prefixes before anything about them is added up.

The corpus is read once. A task takes documents in blocks and writes, per level, how many documents of
the block have a prefix, and for whole terms also the source and the occurrences; the levels are then
refined over these rows. Prefix sets are joined and never sent to every task by force.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import column_bytes, kept_in_store, slices
from creditloom.session import scratch_path

LEAST_DOCS = 30
TOP_TERMS = 50
#: Shares are in parts of SCALE, counts raised by PRIOR.
SCALE = 1_000_000_000
PRIOR = 5
#: Words of a block of documents; a longer document is a block alone.
BLOCK_WORDS = 3_000_000
BATCH_ROWS = 1 << 16

#: Bytes of letters, A-Z in lower case; all others part terms.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_ROWS = "level int, lang string, source string, item binary, docs long, n long"


def terms_of(raw: bytes) -> list[bytes]:
    """Stretches of ASCII letters, in lower case, and of anything beyond ASCII."""
    return raw.translate(_LETTERS).split()


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, how often each occurs, and sums of the values per key."""
    turn = np.argsort(keys)
    keys = keys[turn]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    often = np.diff(np.append(first, len(keys)))
    return [keys[first], often, *[np.add.reduceat(v[turn], first) if len(first) else v for v in values]]


class Block:
    """Documents of one language: the terms of each as numbers."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.words, self.sizes, self.sources = array("i"), [], []

    def add(self, source: str, terms: list[bytes]) -> None:
        self.words.extend(map(self.numbers.__getitem__, terms))
        self.sizes.append(len(terms))
        self.sources.append(source)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """Rows of whole terms (level 0) per source, and of prefixes of 1, 2, 4, ... bytes."""
        terms = list(self.numbers)
        if not terms:
            return
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        pairs, often = _sums(doc * len(terms) + np.frombuffer(self.words, dtype=np.int32))
        doc, term = np.divmod(pairs, len(terms))
        names = sorted(set(self.sources))
        number = {s: i for i, s in enumerate(names)}
        source = np.array([number[s] for s in self.sources])[doc]
        keys, docs, n = _sums(source * len(terms) + term, often)
        yield from self._batches(0, lang, np.asarray(names, dtype=object)[keys // len(terms)], pa.array(terms, pa.binary()), keys % len(terms), docs, n)
        sizes, level = np.array([len(t) for t in terms]), 1
        while (long := np.flatnonzero(sizes >= level)).size:
            found: dict[bytes, int] = defaultdict(count().__next__)
            prefix = np.full(len(terms), -1)
            prefix[long] = [found[terms[t][:level]] for t in long.tolist()]
            some = prefix[term] >= 0
            seen, _ = _sums(doc[some] * len(found) + prefix[term[some]])
            docs = np.bincount(seen % len(found), minlength=len(found))
            every = np.arange(len(found))
            yield from self._batches(level, lang, None, pa.array(list(found), pa.binary()), every, docs, docs)
            level *= 2

    @staticmethod
    def _batches(level, lang, sources, items: pa.Array, item, docs, n) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(item), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            rows = len(item[part])
            columns = [
                pa.array(np.full(rows, level, dtype=np.int32)),
                pa.array([lang] * rows, pa.string()),
                pa.array([None] * rows if sources is None else sources[part], pa.string()),
                items.take(pa.array(item[part])),
                pa.array(docs[part].astype(np.int64)),
                pa.array(n[part].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["level", "lang", "source", "item", "docs", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[str, Block] = defaultdict(Block)
    held = 0
    for given in batches:
        for part in slices(given, "text"):
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            for lang, source, raw in zip(langs, sources, column_bytes(part.column("text")), strict=True):
                terms = terms_of(raw)
                if held and held + len(terms) > BLOCK_WORDS:
                    for name, block in blocks.items():
                        yield from block.rows(name)
                    blocks, held = defaultdict(Block), 0
                blocks[lang].add(source, terms)
                held += len(terms)
    for name, block in blocks.items():
        yield from block.rows(name)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Terms in at least ``least`` documents of a language: lang, term, docs, n, uses (source, n).

    Null texts, langs and sources are empty ones, repeated rows are documents each, an empty table
    has no terms. ``uses`` has an entry per source of the language that uses the term.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "prefixes")
    _named(docs).mapInArrow(_counted, _ROWS).write.partitionBy("level").parquet(path)
    # The level is a folder's name there; a table without terms has no folder.
    rows = spark.read.schema(_ROWS).parquet(path)
    kept: DataFrame | None = None
    levels, level = [], 1
    while True:
        here = rows.where(F.col("level") == level).select("lang", "item", "docs")
        here = here.withColumn("stem", F.expr(f"substring(item, 1, {level // 2})"))
        if kept is not None:
            here = here.join(kept.select("lang", F.col("item").alias("stem")), ["lang", "stem"], "left_semi")
        found = here.groupBy("lang", "stem", "item").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        kept = kept_in_store(found.select("lang", "item"), f"prefixes-{level}")
        if kept.isEmpty():
            break
        levels.append(kept)
        level *= 2
    every = levels[0] if levels else kept
    for more in levels[1:]:
        every = every.unionByName(more)
    # The longest level that a term fills: the highest bit of its length.
    filled = F.expr("substring(item, 1, shiftleft(1, length(bin(octet_length(item))) - 1))")
    whole = rows.where("level = 0").withColumn("stem", filled)
    whole = whole.join(every.withColumnRenamed("item", "stem"), ["lang", "stem"], "left_semi")
    used = whole.groupBy("lang", "stem", "item", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    per_term = used.groupBy("lang", "stem", "item").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("uses")
    )
    return per_term.where(F.col("docs") >= least).select("lang", F.col("item").cast("string").alias("term"), "docs", "n", "uses")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact; null without terms."""
    whole = [c.cast("decimal(25,0)") for c in (n + PRIOR, total + PRIOR * terms)]
    return 1 + F.call_function("div", whole[0] * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(whole[1], F.lit(0)))


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    if max(int(n.max(initial=0)), int(total.max(initial=0)) + terms) > 1 << 32:
        n, total = n.astype(object), total.astype(object)
    return (1 + SCALE * (n + PRIOR) // (total + PRIOR * terms)).astype(np.int64)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's terms of the absolute differences between the shares of any two sources."""
    sums: dict[str, tuple[list[str], np.ndarray]] = {}
    for batch in batches:
        terms: dict[str, list[int]] = defaultdict(list)
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            terms[lang].append(i)
        for lang, at in terms.items():
            rows = batch.take(pa.array(at))
            groups = rows.column("groups")[0].as_py()
            names, total = [g["source"] for g in groups], np.array([g["total"] for g in groups])
            held = sums.setdefault(lang, (names, np.zeros((len(names), len(names)), dtype=np.int64)))[1]
            number = {s: i for i, s in enumerate(names)}
            used = rows.column("uses")
            flat, sizes = used.flatten(), np.diff(used.offsets.to_numpy())
            n = np.zeros((len(at), len(names)), dtype=np.int64)
            place = np.repeat(np.arange(len(at)), sizes), [number[s] for s in flat.field("source").to_pylist()]
            n[place] = flat.field("n").to_numpy(zero_copy_only=False)
            p = _shares(n, total, rows.column("terms")[0].as_py())
            for i in range(len(names)):
                held[i] += np.abs(p - p[:, i : i + 1]).sum(axis=0)
    for lang, (names, held) in sums.items():
        for i, name in enumerate(names):
            arrays = [pa.array([lang] * len(names)), pa.array([name] * len(names)), pa.array(names), pa.array(held[i])]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources are apart, and what each uses more.

    A share p of a term is ``share`` of its occurrences in a source, or in the language. Part "pair":
    for every other source of the language the sum of |p - q| over the language's kept terms (0
    without any). Part "term": the ``top`` kept terms a source has with a greater share than its
    language, by that difference. Equal values are ranked by the item's bytes. Null texts, langs and
    sources are empty ones; a source without terms has shares all the same; an empty table gives no
    rows; a text of any length is counted whole. Columns other than lang, source, text are not read.
    """
    terms = kept_in_store(kept_terms(docs, least), "terms")
    per_source = terms.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source"))
    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = _named(docs).select("lang", "source").distinct()
    groups = groups.join(per_source.agg(F.sum("u.n").alias("total")), ["lang", "source"], "left").join(per_lang, "lang", "left")
    # As a table, so that its true size decides how it is joined.
    groups = kept_in_store(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")

    listed = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"), F.max("terms").alias("terms")
    )
    apart = terms.select("lang", "uses").join(listed, "lang").mapInArrow(
        _distances, "lang string, source string, item string, value long"
    )
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang")
    pairs = others.where(F.col("source") != F.col("item")).join(apart, ["lang", "source", "item"], "left").na.fill(0, ["value"])

    each = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("uses").alias("u"))
    each = each.select("lang", "term", "lang_n", "u.source", "u.n").join(groups, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    ahead = each.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [
        frame.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
        for frame, part in ((pairs, "pair"), (ahead, "term"))
    ]
    both = ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")
