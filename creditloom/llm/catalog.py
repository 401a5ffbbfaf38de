"""Queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import divergence, lines, minhash, mixing, packing, pii, preference, repeats, sentence_pieces, simhash, suffix_tree, toxicity, warc
from creditloom.llm.common import held_out, table
from creditloom.session import pin_settings

#: Vocabulary file of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_settings(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


@query(
    "op1_preference_format",
    """
WITH said AS (
  SELECT conv_id, turn, role, text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn
  FROM conversations
), sides AS (
  SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn = last_turn
    THEN substring(text, 1, CAST(floor(length(text) / 2) AS INT)) ELSE text END AS short
  FROM said
), split AS (
  SELECT *, min(CASE WHEN short IS DISTINCT FROM text THEN turn END) OVER (PARTITION BY conv_id) AS differs
  FROM sides
), long AS (
  SELECT conv_id, turn, role, text AS said, 'chosen' AS side, differs FROM split
  UNION ALL SELECT conv_id, turn, role, short, 'rejected', differs FROM split
), rendered AS (
  SELECT *, differs IS NULL OR turn < differs AS early,
    '<|' || role || '|>' || chr(10) AS head, coalesce(said, '') || '<|end|>' AS body
  FROM long
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, side, early
    ORDER BY turn, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM rendered
), spans AS (
  SELECT *, CASE WHEN role = 'assistant' THEN CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT) END AS span
  FROM placed
)
SELECT conv_id AS pair_id, CAST(floor(turn / 256) AS BIGINT) AS part,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, role, said) FILTER (side = 'chosen' AND early), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, role, said) FILTER (side = 'chosen' AND NOT early), '') AS chosen,
  coalesce(string_agg(span, ',' ORDER BY turn, role, said) FILTER (side = 'chosen' AND NOT early), '') AS chosen_mask,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY turn, role, said) FILTER (side = 'rejected' AND NOT early), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, role, said) FILTER (side = 'rejected' AND NOT early), '') AS rejected_mask
FROM spans GROUP BY 1, 2
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its last reply cut in half."""
    pairs = preference.shortened_replies(table(spark, sf_dir, "conversations"), preference.PART_TURNS)
    return preference.format_preferences(pairs, preference.PART_TURNS)


@query("op2_suffix_tree_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


@query("op3_line_labelling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.judge_lines(docs, lines.fit_field(docs, table(spark, sf_dir, "labels")))


@query("op4_one_permutation_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compared_with_next(table(spark, sf_dir, "documents"))


@query("op5_toxicity_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, net).select(
        "doc_id",
        held_out("doc_id", toxicity.FOLDS).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    "op6_warc_archives",
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
  FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op7_simhash_components")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op8_sentence_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.encode_documents(docs, sentence_pieces.load_encoder(PIECES))


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit_spans(docs))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return found.select("doc_id", *counts, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query(
    "op10_weighted_fair_mix",
    """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substring(md5('7:' || doc_id), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
    row_number() OVER (ORDER BY source NULLS FIRST) AS source_no
  FROM sized GROUP BY source
), levels AS (
  SELECT *, source_size * CAST(3.0 AS DOUBLE) AS cap, source_size * CAST(3.0 AS DOUBLE) / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(source_size * CAST(3.0 AS DOUBLE)) OVER before, 0))
      / sum(weight) OVER rest AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size * CAST(3.0 AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY source_size * CAST(3.0 AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), aimed AS (
  SELECT source, source_size, source_no, CASE WHEN level <= ratio
    THEN max(CASE WHEN level <= ratio THEN level END) OVER () * weight ELSE cap END AS target
  FROM levels
), served AS (
  SELECT s.*, a.source_size, a.source_no, a.target,
    CAST(sum(size) OVER (PARTITION BY a.source_no ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ended
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), laps AS (
  SELECT *, repeat * source_size + ended AS done,
    least((repeat * source_size + ended) / target, 1.0) AS finish,
    greatest(least(size, CAST(round(target) AS BIGINT) - repeat * source_size - ended + size), 0) AS here
  FROM served, (SELECT unnest([0, 1, 2]) AS repeat)
  WHERE target > 0 AND repeat <= ceil((target - (ended - size)) / CAST(source_size AS DOUBLE)) - 1
), placed AS (
  SELECT *, CAST(sum(here) OVER (ORDER BY finish, source_no, repeat, done, h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position,
    (SELECT sum(size) FROM sized) AS budget
  FROM laps
), cut AS (
  SELECT doc_id, position, greatest(here - greatest(position - budget, 0), 0) AS here FROM placed
), taken AS (
  SELECT doc_id, CAST(sum(here) AS BIGINT) AS taken, min(CASE WHEN here > 0 THEN position END) AS first_position
  FROM cut GROUP BY doc_id
)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, s.source_size, s.target, coalesce(t.taken, 0) AS taken, t.first_position
FROM served s LEFT JOIN taken t USING (doc_id)
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op11_harmonic_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(BYTE_BPE, encoding="utf-8") as file:
        packed = packing.pack_documents(table(spark, sf_dir, "documents"), file.read())
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_runs(repeats.repeated_texts(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    longest = found.withColumn("best", best)
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.n div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op13_source_divergence",
    """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
  FROM documents
), w AS (
  SELECT doc, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), used AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), t AS (
  SELECT lang, source, sum(n) AS total FROM used GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source)
    LEFT JOIN used ON used.lang = g.lang AND used.source = g.source AND used.term = kept.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))
