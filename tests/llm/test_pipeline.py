"""Stages of the pipeline on odd rows, and what they decide."""

import random
import re

import xxhash

import corpus_pipeline
from creditloom.llm import toxicity
from creditloom.llm.common import kept_in_store

from llm_fixtures import no_docs, odd_docs, sample  # noqa: F401  (fixtures)

SF = "/root/testdata/sf0.01"


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = kept_in_store(stage(spark, docs, SF), name)
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert kept.count() == scored.where("toxicity < 0.5").count() < docs.count()
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert one.count() == docs.select("text").distinct().count()
    assert corpus_pipeline.redact(spark, docs, SF).where("text rlike '[a-z]@mail[0-9]'").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(spark, texts, sources=("a",)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def _plain_bits(text):
    words = [w for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_planted_near_copies_leave_the_first_of_each_group(spark):
    """Copies with a word exchanged, chains of them and exact copies, against all pairs and a plain search."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for group in range(12):
        words = draw.choices(vocabulary, k=300)
        texts.append(" ".join(words))
        for copy in range(group % 5):
            words = [*words]
            words[draw.randrange(300)] = draw.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [texts[0], texts[3].upper(), ""]
    draw.shuffle(texts)
    bits = [_plain_bits(t) for t in texts]
    first = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(bits):
            first[i] = min(first[j] for j, b in enumerate(bits) if (a ^ b).bit_count() <= 3)
    expected = sorted(set(first))
    kept = corpus_pipeline.drop_near_duplicates(spark, _documents(spark, texts).repartition(4), SF)
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert 13 <= len(expected) < len(texts) - 8


def test_planted_personal_data_goes_and_the_rest_stays(spark):
    words = "the report was read by all members of the board and then filed".split()
    planted = ["jo.li+x@mail.example.org", "10.20.30.40", "4111 1111 1111 1111", "+49 (30) 1234-5678"]
    clean = [" ".join(words[i:] + words[:i]) for i in range(12)]
    texts = clean + [f"{t} {planted[i % 4]} {t}" for i, t in enumerate(clean)]
    out = {r.doc_id: r for r in corpus_pipeline.redact(spark, _documents(spark, texts), SF).collect()}
    assert [out[i].text for i in range(12)] == clean
    for i, t in enumerate(clean, 12):
        left, right = out[i].text[: len(t) + 1], out[i].text[-len(t) - 1 :]
        assert left == t + " " and right == " " + t and planted[i % 4] not in out[i].text
        assert out[i].n_chars == len(out[i].text) > 2 * len(t) + 2


def test_mixture_meets_targets_worked_by_hand(spark):
    """Sources of 300, 600 and 2,700 words at weights 1, 2, 3: 600, 1,200, 1,800 words are below three times each."""
    texts = []
    for i in range(180):
        n = (5, 10, 45)[i % 3]
        texts.append(" ".join(f"d{i}w{j}" for j in range(n)))
    taken = corpus_pipeline.mix_sources(spark, _documents(spark, texts, "abc"), SF).collect()
    words = {s: sum(len(r.text.split()) for r in taken if r.source == s) for s in "abc"}
    for source, target in {"a": 600, "b": 1200, "c": 1800}.items():
        assert abs(words[source] - target) <= 45, (source, words)
    assert sum(words.values()) == 3600
    for r in taken:
        assert texts[r.doc_id].startswith(r.text)


def test_toxic_documents_go_and_clean_ones_stay_by_their_labels(spark):
    """Rows outside the fit, graded by the table of labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    unseen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    clean = [r.doc_id for r in unseen if r.toxic == 0]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) > 0
