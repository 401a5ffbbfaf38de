"""Mixing sources to target weights by weighted fair queueing (native).

Each source is a queue of its documents in shuffled order, repeated as often as its target needs.
A document's virtual finish time is the number of words its source has served by its end, divided
by the source's target; time 1 is when the budget is used up. The documents are put in one global
order of finish times, and the order is cut at the budget. The document a source is serving when
the time is up is cut to the words it got, as fair queueing serves words and not documents.

Running totals never use one task per source: rows are dealt into numbered buckets, the buckets
are summed, and a row's total is that of the earlier buckets and of the rows before it in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import kept_in_store, text_of, word_count

MOST_REPEATS = 3
BUCKET_ROWS = 20_000


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest, the place of a document in its source's shuffled order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1..cycle, repeating, by code point of the source name, a missing name last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))


def targets(sources: DataFrame, most: float = MOST_REPEATS) -> DataFrame:
    """Adds ``target``: shares by weight of all words, none above ``most`` times its source's size.

    What a capped source cannot take goes to the others by weight until none is above its cap, which
    is the common level L with target = min(cap, L * weight). Sources sorted by cap / weight are
    capped first, so one pass in that order finds L. The frame has one row per source.
    """
    ratio = F.col("cap") / F.col("weight")
    earlier = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    rest = earlier.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", ratio)
        .withColumn("_total", F.sum("source_size").over(all_rows))
        .withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_used")) / F.sum("weight").over(rest))
        .withColumn("_open", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_found", F.max("_open").over(all_rows))
    )
    # Levels fall after the first that fits, which is the answer, so it is the largest of those.
    target = F.when(F.col("_open").isNotNull(), F.col("_found") * F.col("weight")).otherwise(F.col("cap"))
    return stepped.withColumn("target", target.cast("double")).drop(
        "cap", "_ratio", "_total", "_used", "_level", "_open", "_found"
    )


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` up to each row, itself included, within its groups.

    ``bucket`` numbers parts of the order; only a part's rows meet in one task. The parts are
    rows / BUCKET_ROWS in number, and their sums are a small table.
    """
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*groups, bucket)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_in", F.sum(value).over(inside))
        .join(offsets, [*groups, bucket])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_before", "_in")
    )


def fair_mix(docs: DataFrame, seed: int = 7, most: int = MOST_REPEATS, digest: bool = False) -> DataFrame:
    """One row per document and repeat that the mix takes from.

    Columns: row_id, doc_id, source, size, source_size, target, repeat (0, 1, ...; null where the mix
    takes nothing), finish (virtual time), taken_here (words), position (words of the mix up to the
    document's end, in the global order).

    A null text has size 0, a null source is a source of its own, repeated rows are separate
    documents in the order of their ids, and an empty table gives no rows. Columns other than
    doc_id, source and text are not read.
    """
    rows = kept_in_store(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text_of()).alias("size"),
            *([F.xxhash64(text_of(), F.col("source")).alias("digest")] if digest else []),
        ),
        "mix-sizes",
    )
    # The weighed sources are stored: all later steps use one and the same set of numbers.
    per_source = rows.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("_rows")
    )
    weighed = targets(source_weights(per_source), most).withColumn("source_no", F.row_number().over(Window.orderBy("source")))
    weighed = kept_in_store(weighed, "mix-targets")
    queued = (
        rows.join(weighed.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_hash", shuffle_key(F.col("doc_id"), seed))
        # Equal slices of the 60-bit key, one for each BUCKET_ROWS rows of the source.
        .withColumn("_parts", F.ceil(F.col("_rows") / BUCKET_ROWS))
        .withColumn("_bucket", F.floor((F.shiftright("_hash", 28) / F.lit(2.0**32)) * F.col("_parts")))
    )
    served = running_total(
        queued, ["source_no"], "_bucket", [F.col("_hash"), F.col("doc_id"), F.col("size"), F.col("row_id")], "size", "_end"
    )
    # Only the repeats that begin before the time is up.
    lap = F.col("source_size").cast("double")
    last = F.when(F.col("target") <= 0, -1).otherwise(
        F.ceil((F.col("target") - (F.col("_end") - F.col("size"))) / lap).cast("int") - 1
    )
    copies = F.when(last >= 0, F.sequence(F.lit(0), F.least(last, F.lit(most - 1))))
    quota = F.round("target").cast("long")
    begun = F.col("repeat").isNotNull()
    words_here = F.greatest(F.least(F.col("size"), quota - F.col("_done") + F.col("size")), F.lit(0))
    laps = (
        served.withColumn("repeat", F.explode_outer(copies))
        .withColumn("_done", F.col("repeat") * F.col("source_size") + F.col("_end"))
        .withColumn("finish", F.when(begun, F.least(F.col("_done") / F.col("target"), F.lit(1.0))))
        .withColumn("taken_here", F.when(begun, words_here).otherwise(0))
    )
    # The global order, cut where the budget ends. Rows the mix does not reach are dealt out evenly.
    totals = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("_budget"),
        F.greatest(F.ceil(F.sum("_rows") / BUCKET_ROWS), F.lit(1)).alias("_slots"),
    )
    slot = F.when(begun, F.floor(F.col("finish") * F.col("_slots"))).otherwise(-1 - F.pmod("_hash", "_slots"))
    timed = laps.crossJoin(F.broadcast(totals)).withColumn("_slot", slot)
    order = [F.col("finish"), F.col("source_no"), F.col("repeat"), F.col("_done"), F.col("_hash"), F.col("doc_id"), F.col("row_id")]
    placed = running_total(timed.withColumn("_all", F.lit(0)), ["_all"], "_slot", order, "taken_here", "position")
    over = F.greatest(F.col("position") - F.col("_budget"), F.lit(0))
    return placed.withColumn("taken_here", F.greatest(F.col("taken_here") - over, F.lit(0))).select(
        "row_id", "doc_id", "source", "size", "source_size", "target", "repeat", "finish", "taken_here", "position",
        *(["digest"] if digest else []),
    )


def mix(docs: DataFrame, seed: int = 7, most: int = MOST_REPEATS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and first_position in the mix."""
    keys = ["row_id", "doc_id", "size", "source_size", "target"]
    return (
        fair_mix(docs, seed, most)
        .groupBy(*keys)
        .agg(
            F.sum("taken_here").cast("long").alias("taken"),
            F.min(F.when(F.col("taken_here") > 0, F.col("position"))).alias("first_position"),
        )
        .drop("row_id")
    )


def mixed_documents(docs: DataFrame, seed: int = 7, most: int = MOST_REPEATS) -> DataFrame:
    """The documents of the mix: one row per repeat that is taken, cut where a source's time ended.

    All columns stay. Rows are matched to their repeats by doc_id, text digest and place among equal
    ones, so repeated rows keep their number; texts are shuffled once. A row that is cut holds its
    first words, as many as were taken, and its n_chars.
    """
    keys = ["_mix_doc", "_mix_digest", "_mix_nth"]
    same = Window.partitionBy("_mix_doc", "_mix_digest").orderBy("_mix_size")
    least = F.lit(-(1 << 63))
    digest = F.xxhash64(text_of(), F.col("source"))
    rows = docs.withColumns(
        {"_mix_doc": F.coalesce(F.col("doc_id").cast("long"), least), "_mix_digest": digest, "_mix_size": word_count(text_of())}
    )
    rows = rows.repartition("_mix_doc", "_mix_digest").withColumn("_mix_nth", F.row_number().over(same))
    parts = fair_mix(docs, seed, most, digest=True).where("taken_here > 0")
    order = Window.partitionBy("_mix_doc", "_mix_digest", "repeat").orderBy("row_id")
    parts = parts.select(
        F.coalesce("doc_id", least).alias("_mix_doc"),
        F.col("digest").alias("_mix_digest"),
        "repeat",
        "row_id",
        F.col("taken_here").alias("_mix_taken"),
    ).withColumn("_mix_nth", F.row_number().over(order))
    joined = rows.join(parts.select(*keys, "_mix_taken"), keys)
    # Words with what separates them from the word before; the first words of a text join to its start.
    pieces = F.expr(r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")
    cut = F.array_join(F.slice(pieces, 1, F.col("_mix_taken").cast("int")), "")
    partly = F.col("_mix_taken") < F.col("_mix_size")
    text = F.when(partly, cut).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.when(partly, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*docs.columns)
