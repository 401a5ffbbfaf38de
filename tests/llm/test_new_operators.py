"""Packing, periodic runs and source divergence against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.llm import catalog, divergence, packing, pii, repeats, warc

from llm_fixtures import no_docs, odd_docs, sample  # noqa: F401  (fixtures)

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    with open(catalog.BYTE_BPE, encoding="utf-8") as file:
        return file.read()


# --- packing ---------------------------------------------------------------------------------


@given(st.integers(1, 100_000))
@settings(max_examples=300, deadline=None)
def test_cut_pieces_waste_little(tokens):
    pieces = packing.cut(tokens)
    assert sum(pieces) == tokens and all(0 < p <= packing.CAPACITY for p in pieces)
    wasted = sum(packing.CAPACITY // (packing.CAPACITY // p) - p for p in pieces)
    assert wasted <= max(2, 1 + tokens // packing.WASTE)


def test_a_class_holds_a_fixed_count():
    bins, rng, placed = packing.Bins(0), random.Random(1), []
    for i in range(3000):
        length = rng.randint(1, packing.CAPACITY)
        placed += bins.add((i, 0, length, b"", length))
    by = defaultdict(list)
    for piece in placed:
        by[piece[5]].append(piece)
    for held in by.values():
        kinds = {packing.CAPACITY // p[2] for p in held}
        assert len(kinds) == 1 and len(held) == kinds.pop() and sum(p[2] for p in held) <= packing.CAPACITY
    assert len(placed) + len(bins.left()) == 3000


def test_fast_ids_are_the_librarys(vocabulary):
    library, fast = tokenizers.Tokenizer.from_str(vocabulary), packing.encoder(vocabulary)
    texts = ["", " ", "\n\n  x", "it's we'LL 12 3¾", "naïve ▁ 日本 🙂", "a<|endoftext|>b", "\x00\x1f\x85 　z", "x" * 5000]
    # Every kind of letter, digit, mark and space beside a word, a blank and itself.
    for start in range(0, 0x30000, 0x400):
        points = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c} {c}1{c}{c}  {c}\n" for c in points))
    assert all(fast(t) == library.encode(t, add_special_tokens=False).ids for t in texts)


def check_packed(pieces, texts, vocabulary, capacity):
    library = tokenizers.Tokenizer.from_str(vocabulary)
    assert Counter((p.doc_id, p.start == 0) for p in pieces)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        assert p.length * 4 == len(p.ids)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    got = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for doc_id, held in by_doc.items():
        expected = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts[doc_id]]
        if len(expected) == 1:
            joined = b"".join(p.ids for p in sorted(held, key=lambda p: p.start))
            assert joined == expected[0].tobytes() and all(p.doc_tokens == len(expected[0]) for p in held)
        got[doc_id] = sum(p.length for p in held)
        assert got[doc_id] == sum(map(len, expected))
    assert set(got) == set(texts)


def test_packing_odd_and_no_rows(odd_docs, no_docs, vocabulary):
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text)
    pieces = packing.pack_documents(odd_docs.repartition(3), vocabulary).collect()
    check_packed(pieces, texts, vocabulary, packing.CAPACITY)
    assert packing.pack_documents(no_docs, vocabulary).count() == 0


def test_packing_over_many_workers_pads_little(sample, vocabulary):
    texts = {r.doc_id: [r.text] for r in sample.collect()}
    pieces = packing.pack_documents(sample.repartition(20, "doc_id"), vocabulary).collect()
    check_packed(pieces, texts, vocabulary, packing.CAPACITY)
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    padded = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in used.values())
    assert padded < 0.005 * sum(used.values())


def test_packing_query(spark):
    rows = catalog.QUERIES["op11_harmonic_packing"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()}
    with open(catalog.BYTE_BPE, encoding="utf-8") as file:
        library = tokenizers.Tokenizer.from_str(file.read())
    for r in rows:
        if r.doc_id in docs:
            ids = np.array([*library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


# --- periodic runs ---------------------------------------------------------------------------


def runs_by_definition(ws):
    n, out = len(ws), []
    for q in range(1, n // 4 + 1):
        same, i = [a == b for a, b in zip(ws, ws[q:])], 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                stretch = ws[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.tuples(st.lists(st.integers(1, 3), max_size=60), st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_runs_equal_their_definition(given_texts):
    texts = []
    for ws, a, p in given_texts:
        part = ws[a : a + p]
        texts.append(ws[:a] + part * 6 + part[: p // 2] + ws[a + p :] if part else ws)
    found = repeats.block_runs(texts)
    assert [found.get(t, []) for t in range(len(texts))] == [runs_by_definition(ws) for ws in texts]


def test_runs_of_very_long_texts():
    assert repeats.block_runs([[1] * 300_000]) == {0: [(0, 300_000, 1)]}
    assert repeats.block_runs([[7, *list(range(1, 4001)) * 50]]) == {0: [(1, 200_000, 4000)]}


def periodic(doc_id, ws):
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def test_runs_query_against_brute_force(spark, sample):
    got = {r.doc_id: r for r in catalog.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == sample.count()
    some = 0
    for doc_id, text in sample.select("doc_id", "text").collect():
        ws = periodic(doc_id, (text or "").encode().split())
        if len(ws) > 1500:
            continue
        runs = runs_by_definition(ws)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        kept = b" ".join(w for i, w in enumerate(ws) if i not in dropped)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        some += len(runs)
    assert some > 100


def test_runs_on_odd_and_no_rows(odd_docs, no_docs):
    assert repeats.find_runs(repeats.repeated_texts(no_docs)).count() == 0
    edited = {(r.doc_id, r.text) for r in repeats.repeated_texts(odd_docs).collect()}
    for r in odd_docs.collect():
        ws = (r.text or "").split()
        assert any(i == r.doc_id and (t or "").split() == periodic(r.doc_id, ws) for i, t in edited)
    for r in repeats.find_runs(odd_docs).collect():
        if r.doc_id == 5:
            assert [tuple(x) for x in r.runs] == [(0, 30_000, 1)] and r.collapsed == "word"
        elif r.doc_id == 7:
            assert [tuple(x) for x in r.runs] == [(0, 20, 4)] and r.collapsed == "naïve ▁ 日本 🙂"
        else:
            assert r.runs == [] and r.collapsed.split(" ") == re.sub(r"[\x20\x09-\x0D]+", " ", r.collapsed).split(" ")


# --- source divergence -----------------------------------------------------------------------


def divergence_by_definition(rows, least, top):
    kept, used, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in found]
        kept[lang or ""].update(set(found))
        used[lang or "", source or ""].update(found)
        langs[lang or ""].update(found)
    out = []
    for lang in kept:
        terms = sorted(t for t, n in kept[lang].items() if n >= least)

        def shares(counts):
            total = sum(counts[t] for t in terms)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(terms)) for t in terms}

        q = shares(langs[lang])
        p = {s: shares(c) for (name, s), c in used.items() if name == lang}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in p if o != s]
            ahead = [(p[s][t] - q[t], t) for t in terms if used[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", ahead, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_divergence_equals_its_definition(spark, odd_docs, least):
    rng = random.Random(least)
    letters = ["a", "b", "Ä", "ß", "é", "日"]
    rows = [
        ("".join(rng.choice([*letters, " ", "7", "-", "Ab"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["x", "y", "z", None]))
        for _ in range(80)
    ]
    rows += [(None, "fr", "only"), ("1 2 3", "it", "p"), ("", "it", "q"), ("x" * 70_000, "en", "x"), ("x" * 70_000, "de", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, least, 3).collect())
    assert got == divergence_by_definition(rows, least, 3)
    odd = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    got = sorted(tuple(r) for r in divergence.source_divergence(odd_docs, least, 3).collect())
    assert got == divergence_by_definition(odd, least, 3)


def test_divergence_of_no_rows(no_docs):
    assert divergence.source_divergence(no_docs).count() == 0
    assert divergence.kept_terms(no_docs).count() == 0


def test_shares_are_exact_for_great_counts(spark):
    n, total, terms = 3 * 10**12 + 1, 7 * 10**13 + 9, 12_345
    (row,) = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).collect()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * terms)
    assert divergence._shares(np.array([[n]]), np.array([total]), terms).tolist() == [[row.p]]


# --- archives and personal data, mended ---------------------------------------------------------


def test_archives_append_and_overwrite(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "archives")

    def put(mode, ids):
        pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 200) for i in ids], "page_id long, url string, html string")
        warc.page_records(pages).write.format("warc").mode(mode).save(path)

    def there():
        read = spark.read.format("warc").load(path)
        return sorted(r.record_id for r in read.collect())

    put("append", range(5))
    put("append", range(5, 10))
    assert there() == sorted(f"urn:page:{i}" for i in range(10))
    put("overwrite", [20])
    assert there() == ["urn:page:20"] and len(list((tmp_path / "archives").glob("*.warc"))) == 1
    put("append", [21])
    put("overwrite", [30, 31])
    put("append", [32])
    assert there() == ["urn:page:30", "urn:page:31", "urn:page:32"]


def test_archive_query_skips_what_each_scan_does_not_want(spark):
    rows = [(i, "u", "<p>same page</p>" * 100) for i in range(6)] + [(None, None, None), (9, "u", "<p>short</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.archived_pages(pages)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in found.collect()}
    assert got[5] == ("response", None, 1600) and all(got[i] == ("revisit", 5, 1600) for i in range(5))
    assert got[None] == ("response", None, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 2 and "Filter" not in plan.replace("PushedFilters", "")


def test_long_numbers_take_linear_time():
    import time

    began = time.time()
    assert pii.base_spans("1.2.3." + "0" * 5_000, b"1.") == [(pii.IP, 0, 5_006)]
    assert pii.base_spans("1.2.3." + "9" * 5_000, b"1.") == []
    for text in ("9" * 1_000_000, "1 " * 500_000, "+1" + "(" * 500_000, "a@" * 300_000):
        assert not any(is_base for *_, is_base in pii.candidates(text, text.encode()))
    dotted = "1." * 400_000
    assert len(pii.candidates(dotted, dotted.encode())) == 100_000
    assert time.time() - began < 20


def test_reliabilities_are_told_apart_by_kind():
    rng = random.Random(3)
    # Labelers say yes or no rightly with these chances; the first is good at one kind, bad at the other.
    right = {pii.EMAIL: (0.95, 0.9, 0.85, 0.8, 0.9), pii.PHONE: (0.55, 0.9, 0.85, 0.9, 0.95)}
    counts = Counter()
    for kind, chances in right.items():
        for _ in range(20_000):
            hit = rng.random() < 0.6
            votes = 0
            for chance in chances:
                said = hit if rng.random() < chance else not hit
                votes = votes * 3 + (pii.YES if said else pii.NO)
            counts[kind, votes, int(hit)] += 1
    model = pii.SpanModel.fit(dict(counts))
    for kind, chances in right.items():
        for labeler, chance in enumerate(chances):
            assert abs(model.reliability[kind, 1, labeler, pii.YES] - chance) < 0.04
            assert abs(model.reliability[kind, 0, labeler, pii.NO] - chance) < 0.04


def test_personal_data_on_odd_and_no_rows(odd_docs, no_docs):
    model = pii.fit_spans(odd_docs)
    got = [(r.doc_id, r.n_email, r.spans) for r in pii.find_personal_data(odd_docs, model).collect()]
    assert len(got) == odd_docs.count() and [(i, s) for i, n, s in got if n] == [(None, "email:22:37")]
    assert all(n == 0 and s == "" for i, n, s in got if i in (3, 4, 6))
    assert pii.redact_personal_data(no_docs, pii.fit_spans(no_docs)).count() == 0


def test_secrets_are_reported_and_left_alone(spark):
    text = 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" and a.b@mail.com'
    docs = spark.createDataFrame([(i, text, len(text)) for i in range(40)], "doc_id long, text string, n_chars long")
    model = pii.fit_spans(docs)
    assert "secret:" in pii.find_personal_data(docs, model).first().spans
    assert pii.redact_personal_data(docs, model).first().text == text.replace("a.b@mail.com", "[EMAIL]")
    assert "[SECRET]" in pii.redact_personal_data(docs, model, range(5)).first().text
