"""One-permutation MinHash fingerprints (native).

Every word shingle is hashed once. The hash picks one of the bins and a value in it, and a bin
keeps its smallest value. An empty bin borrows from the first filled bin in an order of all bins
that is its own and the same for every document (optimal densification). Of each value only the low
bits are stored, packed into a hexadecimal string; likeness is the share of equal bins, corrected
for the bits that agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import kept_in_store, lowered, text_of, words

SHINGLE_WORDS = 5
BINS = 256
BITS = 4
#: Tries of an empty bin one by one, before all filled bins are ranked at once. Either way finds the
#: same bin.
SINGLE_TRIES = 6
VALUE_BITS = 40
LEAST_LONG = -(1 << 63)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and not wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _constants(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of a text's word shingles, in the order they occur, repeats included.

    A text of fewer words is one shingle of all of them, a text without words one empty shingle.
    """
    hashed = F.transform(words(lowered(text)), lambda w: F.xxhash64(w))

    def of_words(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    return _let(hashed, of_words)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, size: int = SHINGLE_WORDS) -> Column:
    """Array with the low bits of every bin's value; equal texts have equal arrays.

    Try number t of empty bin i is bin (a[i] * t + b[i]) mod bins. With odd a[i] this goes through
    all bins once, so the first filled one is found whatever the text.
    """
    width = bins.bit_length() - 1
    if bins != 1 << width or not 1 <= width <= 20:
        raise ValueError("bins must be a power of two, two at least")
    steps = [(i * 0x9E3779B1 ^ i >> 3 ^ 0x2545F491) % bins | 1 for i in range(bins)]
    starts = [(i * 0x85EBCA6B + 0x27D4EB2F >> 7) % bins for i in range(bins)]
    a, b = _constants(steps), _constants(starts)
    back = _constants([pow(s, -1, bins) for s in steps])
    value_mask, mark = (1 << VALUE_BITS) - 1, 1 << VALUE_BITS

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, VALUE_BITS + 1)

    # bin number, a bit for elements that only mark a bin, value
    hashed = F.transform(
        shingle_hashes(text, size),
        lambda h: F.shiftleft(F.shiftrightunsigned(h, 64 - width), VALUE_BITS + 1).bitwiseOR(h.bitwiseAND(value_mask)),
    )
    marks = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.shiftleft(i.cast("long"), VALUE_BITS + 1) + mark)

    def smallest(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
        return F.transform(first, lambda x: F.when(x.bitwiseAND(mark) == 0, x.bitwiseAND(value_mask)))

    def densified(v: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.get(v, j).isNotNull())

        def with_filled(f: Column) -> Column:
            def tried(i: Column, t: Column | int) -> Column:
                return F.get(v, (F.get(a, i) * t + F.get(b, i)).bitwiseAND(bins - 1))

            def ranked(i: Column) -> Column:
                tries = F.transform(f, lambda j: ((j - F.get(b, i)) * F.get(back, i)).bitwiseAND(bins - 1))
                return tried(i, F.array_min(tries))

            return F.transform(v, lambda x, i: F.coalesce(x, *[tried(i, t) for t in range(SINGLE_TRIES)], ranked(i)))

        return _let(filled, with_filled)

    dense = _let(_let(F.sort_array(F.concat(hashed, marks)), smallest), densified)
    return F.transform(dense, lambda x: x.bitwiseAND((1 << bits) - 1).cast("tinyint"))


def as_hex(codes: Column) -> Column:
    """Codes of up to four bits, one hexadecimal digit each."""
    digits = F.split(F.lit("0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f"), ",")
    return F.array_join(F.transform(codes, lambda c: F.get(digits, c.cast("int"))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated resemblance 0..1: the share of equal bins less what agrees by chance."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    chance = 1.0 / (1 << bits)
    return F.greatest(F.lit(0.0), (equal / F.size(a) - chance) / (1.0 - chance))


def before_in_order(keys: DataFrame) -> DataFrame:
    """(k, before_k, before_n): for each key the next larger one, for the largest the smallest.

    ``keys`` holds unique longs k with a value n. The keys are range-sorted into parts that are
    stored, so that both uses see the same parts; only the parts' first keys meet in one task.
    """
    parts = kept_in_store(
        keys.repartitionByRange(F.col("k")).withColumn("part", F.spark_partition_id()), "ordered-keys"
    )
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = (
        parts.groupBy("part")
        .agg(F.min("k").alias("_k"), F.min_by("n", "k").alias("_n"))
        .select(
            "part",
            F.coalesce(F.lead("_k").over(order), F.first("_k").over(everything)).alias("_next_k"),
            F.coalesce(F.lead("_n").over(order), F.first("_n").over(everything)).alias("_next_n"),
        )
    )
    inside = Window.partitionBy("part").orderBy("k")
    # One row per part, and parts are as many as a shuffle has.
    return parts.withColumns({"_k": F.lead("k").over(inside), "_n": F.lead("n").over(inside)}).join(
        F.broadcast(firsts), "part"
    ).select("k", F.coalesce("_k", "_next_k").alias("before_k"), F.coalesce("_n", "_next_n").alias("before_n"))


def compared_with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and two likenesses.

    The next document is that of the next smaller doc_id, after the smallest the largest. In the
    edited text the last third of the code points gives way to as many from the start of the next
    document, or all it has. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A null text is empty. A row without a doc_id sorts below all others. Rows of one doc_id stay
    separate rows, but only the first of them by a digest of the text is the next document of
    others. A lone document is its own next. An empty table gives no rows.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("k"), text_of().alias("text")
    )
    digest = F.xxhash64("text")
    first = F.min(F.struct(digest.alias("h"), F.char_length("text").alias("n"))).alias("first")
    before = before_in_order(rows.groupBy("k").agg(first).select("k", F.col("first.n").alias("n")))
    # The only shuffle of whole texts; both joins below read it.
    placed = (
        rows.withColumn("codes", fingerprint(F.col("text"), bins, bits, size))
        .repartition("k")
        .withColumn("_nth", F.row_number().over(Window.partitionBy("k").orderBy(digest)))
    )
    starts = (
        placed.where("_nth = 1")
        .join(before, "k")
        .select(
            F.col("before_k").alias("k"),
            F.col("codes").alias("next_codes"),
            F.expr("substring(text, 1, cast(floor(before_n / 3) as int))").alias("start"),
        )
    )
    edited = placed.join(starts, "k").select(
        F.when(F.col("k") != LEAST_LONG, F.col("k")).alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        "codes",
        "next_codes",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.col("start")).alias("edited"),
    )
    coded = edited.withColumn("edited_codes", fingerprint(F.col("edited"), bins, bits, size))
    return coded.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("codes")).alias("fingerprint"),
        as_hex(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes"), bits).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes"), bits).alias("near_next"),
    )
