"""Operators against brute force, hand-worked values and edge cases."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from creditloom.llm import catalog, lines, minhash, mixing, pii, preference, sentence_pieces, simhash, suffix_tree, toxicity, warc

from llm_fixtures import no_docs, odd_docs, sample  # noqa: F401  (fixtures)

SF = "/root/testdata/sf0.01"
GAP = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, lower=False):
    text = text or ""
    return [w for w in GAP.split(text.translate(LOWER) if lower else text) if w]


# --- preference formatting -------------------------------------------------------------------


def _turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")


def test_preference_prefix_and_masks(spark):
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")]
    rows += [(1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "bye")]
    (row,) = preference.format_preferences(_turns(spark, rows)).collect()
    assert row.prompt == "<|user|>\nhi<|end|>\n"
    assert row.chosen == "<|assistant|>\nyes<|end|>\n" and row.chosen_mask == "14:24"
    start, end = map(int, row.chosen_mask.split(":"))
    assert row.chosen[start:end] == "yes<|end|>"
    assert row.rejected.endswith("<|user|>\nbye<|end|>\n") and row.rejected_mask == "14:23"


def test_preference_odd_rows(spark):
    rows = [(None, "chosen", 0, None, None), (None, "rejected", 0, None, ""), (2, "chosen", None, "user", "x")]
    rows += [(3, s, 0, "user", "same") for s in ("chosen", "chosen", "rejected", "rejected", "other")]
    got = {r.pair_id: r for r in preference.format_preferences(_turns(spark, rows)).collect()}
    assert got[None].prompt == "" and got[None].chosen == "<||>\n<|end|>\n"
    assert got[2].chosen == "<|user|>\nx<|end|>\n" and got[2].rejected == ""
    assert got[3].prompt == "<|user|>\nsame<|end|>\n" * 2 and got[3].chosen == ""
    assert preference.format_preferences(_turns(spark, [])).count() == 0


def test_preference_long_conversation_is_one_row_with_masks_over_it(spark):
    rows = [(1, s, t, "user", f"t{t}") for s in ("chosen", "rejected") for t in range(700)]
    rows += [(1, "chosen", t, ("assistant", "user")[t % 2], f"a{t}") for t in range(700, 1300)]
    (row,) = preference.format_preferences(_turns(spark, rows).repartition(5)).collect()
    assert row.prompt.count("<|user|>") == 700 and row.rejected == row.rejected_mask == ""
    spans = [tuple(map(int, x.split(":"))) for x in row.chosen_mask.split(",")]
    assert [row.chosen[a:b] for a, b in spans] == [f"a{t}<|end|>" for t in range(700, 1300, 2)]


def test_preference_ties_and_repeats_part_at_their_turn(spark):
    rows = [(1, s, 0, "user", "same") for s in ("chosen", "rejected")]
    rows += [(1, "chosen", 1, "user", x) for x in "bab"] + [(1, "rejected", 1, "user", x) for x in "aba"]
    rows += [(1, s, 2, "assistant", "equal again") for s in ("chosen", "rejected")]
    rows = [(*r, "clash") for r in rows]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string")
    (row,) = preference.format_preferences(turns).collect()
    assert row.prompt == "<|user|>\nsame<|end|>\n"
    assert [x.split("<|end|>")[0] for x in row.chosen.split("<|user|>\n")[1:]] == ["a", "b", "b"]
    assert [x.split("<|end|>")[0] for x in row.rejected.split("<|user|>\n")[1:]] == ["a", "a", "b"]
    assert row.chosen.endswith("equal again<|end|>\n") and row.rejected.endswith("equal again<|end|>\n")


def test_preference_query_shuffles_texts_once(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x"), (None, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    df = preference.format_preferences(preference.shortened_replies(turns))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and len(df.collect()) == 2


BROADCAST = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


def _long_conversations(spark):
    """Parts before, at and after the parting turn, and odd keys: no conv_id, null turns, one of no assistant."""
    rows = [(c, t, ("assistant", "user")[(t + c) % 2], "ä" * (t % 7) + str(t)) for c in (1, 2) for t in range(-10, 40)]
    rows += [(3, t, "assistant" if t in (5, 7) else "user", None if t % 4 == 0 else f"x{t}") for t in range(45)]
    rows += [(None, t, "assistant" if t < 12 else "user", f"n{t}") for t in range(30)]
    rows += [(4, t, "user", f"u{t}") for t in range(25)] + [(4, None, "user", "late"), (5, None, "assistant", "only")]
    rows += [(6, 3, "assistant", x) for x in ("tie", "tie", "a")] + [(6, 30, "user", "end")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_preference_parts_joined_are_the_single_row(spark, broadcast):
    turns = _long_conversations(spark)
    try:
        for name in BROADCAST:
            spark.conf.set(name, broadcast)
        parts = preference.format_preferences(preference.shortened_replies(turns, 10), 10).collect()
    finally:
        for name in BROADCAST:
            spark.conf.unset(name)
    whole = preference.format_preferences(preference.shortened_replies(turns)).collect()
    assert sorted((p.pair_id or 0, p.part) for p in parts if p.part is not None) == sorted(
        {(r.conv_id or 0, r.turn // 10) for r in turns.collect() if r.turn is not None}
    )
    assert sorted(p.pair_id for p in parts if p.part is None) == [4, 5]
    columns = {"prompt": "", "chosen": "", "chosen_mask": ",", "rejected": "", "rejected_mask": ","}
    for row in whole:
        own = sorted((p for p in parts if p.pair_id == row.pair_id), key=lambda p: (p.part is None, p.part))
        assert {c: gap.join(p[c] for p in own if p[c]) for c, gap in columns.items()} == {c: row[c] for c in columns}


def test_preference_query_gives_every_part_of_a_long_conversation(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2 if t < 301 else 0], f"t{t}") for t in range(700)] + [(2, 0, "assistant", "short")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalog.QUERIES["op1_preference_format"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(db.sql(catalog.SQL["op1_preference_format"]).fetchall())
    parts = {(r.pair_id, r.part): r for r in found.collect()}
    assert sorted(parts) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert parts[1, 0].chosen == "" and parts[1, 1].chosen_mask == "14:25" and parts[1, 2].chosen.count("<|user|>") == 188


def test_preference_parts_shuffle_texts_once_and_by_part(spark):
    try:
        for name in BROADCAST:
            spark.conf.set(name, "-1")
        df = preference.format_preferences(preference.shortened_replies(_long_conversations(spark), 10), 10)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    finally:
        for name in BROADCAST:
            spark.conf.unset(name)
    dealt = [line for line in plan if "- Exchange hashpartitioning" in line]
    # Last turns by conversation and by part, texts by part; sums by pair and back by part.
    assert len(dealt) == 5 and sum("turn#" in line for line in dealt) == 1
    assert sum("ReusedExchange" in line and "text#" in line for line in plan) == 1


# --- suffix tree -----------------------------------------------------------------------------


def test_base_and_tree_scores(spark, sample):
    docs = sample.limit(200)
    texts = {r.doc_id: [w.encode() for w in words_of(r.text, True)] + [b"\n"] for r in docs.collect()}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in learn for w in texts[i])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in suffix_tree.score_texts(docs, block_bytes=1 << 17).collect()}
    for i, ws in texts.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].held_out == (i not in learn)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    held = catalog.QUERIES["op2_suffix_tree_scores"](spark, SF).where("held_out").groupBy().sum("score", "base_score").first()
    assert held[0] > held[1]


def test_contexts_are_kept_by_count_and_not_by_share(spark):
    rng = np.random.default_rng(1)
    filler = bytes(rng.integers(97, 123, 1_500_000, dtype=np.uint8))
    filler = b" ".join(filler[i : i + 6] for i in range(0, len(filler), 6)).decode()
    # A context seen 30 times in 3,500,000 positions; no row is held out.
    rows = [*[(1, filler)] * 2, *[(1, "zqxjk")] * 30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert zlib.crc32(b"1") % 10
    scores = [r.score for r in suffix_tree.score_texts(docs).where("n_tokens = 2").collect()]
    # The word is nearly certain after its first letter or two.
    assert len(scores) == 30 and all(x > -8 for x in scores)


class PlainTree:
    """The tree by its definition: a dictionary from contexts to counts of the next symbol."""

    def __init__(self, texts, least_count, least_gain):
        self.next = {}
        for words in texts:
            symbols = b"\xff" * 5 + b" ".join([*words, b"\xff"])
            for i in range(5, len(symbols)):
                for k in range(6):
                    self.next.setdefault(symbols[i - k : i], Counter())[symbols[i]] += 1
        kept = set()
        for context, counts in self.next.items():
            total = sum(counts.values())
            if len(context) > 2:
                shorter = self.next[context[1:]]
                below = sum(shorter.values())
                gain = sum(n * math.log2(n / total / (shorter[x] / below)) for x, n in counts.items())
                if total < least_count or gain < least_gain:
                    continue
            kept |= {context[i:] for i in range(len(context) + 1)}
        self.kept = kept

    def symbol(self, context, x):
        empty = self.next.get(b"", Counter())
        p = (empty[x] + 0.5) / (sum(empty.values()) + 128)
        for k in range(1, 6):
            suffix = context[len(context) - k :]
            if suffix not in self.kept:
                break
            weight = len(self.next[suffix]) + 0.5
            p = (self.next[suffix][x] + weight * p) / (sum(self.next[suffix].values()) + weight)
        return p

    def tokens(self, words):
        symbols = b"\xff" * 5 + b" ".join([*words, b"\xff"])
        out = [0.0]
        for i in range(5, len(symbols)):
            out[-1] += math.log10(self.symbol(symbols[i - 5 : i], symbols[i]))
            if symbols[i] == 0x20:
                out.append(0.0)
        return out


def test_scores_are_those_of_a_plain_tree(spark, sample):
    docs = sample.limit(120)
    texts = {r.doc_id: suffix_tree.normal(r.text.encode()) for r in docs.collect()}
    learn = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10]
    tree = PlainTree(learn, 6, 8.0)
    assert sum(len(c) > 2 for c in tree.kept) > 300
    c = Counter(w for ws in learn for w in ws)
    n = sum(c.values()) + len(learn)
    got = suffix_tree.score_texts(docs, block_bytes=1 << 16, least_gain=8.0, least_count=6).collect()
    assert len(got) == 120
    for r in got:
        ws = texts[r.doc_id]
        shares = [c[w] / n for w in ws] + [len(learn) / n]
        want = sum(math.log10(0.85 * 10.0**t + 0.15 * s) for t, s in zip(tree.tokens(ws), shares, strict=True))
        assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-3)


def test_gibberish_is_less_likely_than_any_ordinary_text(spark, sample):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = [(-10 - i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(10))) for i in range(40)]
    docs = sample.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    held = [r for r in suffix_tree.score_texts(docs).where("held_out").collect()]
    gibberish = [r.score / r.n_tokens for r in held if r.doc_id < 0]
    ordinary = [r.score / r.n_tokens for r in held if r.doc_id >= 0 and r.n_tokens > 10]
    assert gibberish and len(ordinary) > 50 and max(gibberish) < min(ordinary)


def test_scores_of_odd_and_no_rows(odd_docs, no_docs):
    assert suffix_tree.score_texts(no_docs).count() == 0
    got = suffix_tree.score_texts(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.score < 0 and math.isfinite(r.base_score) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 6)} == {1}
    alone = suffix_tree.score_texts(odd_docs.where("doc_id is null")).collect()
    assert all(r.base_score == 0 and r.score < 0 and r.held_out for r in alone)


# --- line labelling --------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    ws = words_of(text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in text), dup, len(hit)


@pytest.mark.parametrize("text", ["", None, "a b a b a b", "x\nx\n\nx y", "é # | é\n" * 4, "a a a a"])
def test_line_counts(text):
    assert lines.described(text.encode() if text is not None else None)[0] == brute_counts(text)


def test_line_counts_of_documents(spark, sample, odd_docs):
    field = lines.LineField.fit([], [])
    docs = sample.limit(150).select("doc_id", "text").unionByName(odd_docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).selectExpr("doc_id - 100 as doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in lines.judge_lines(docs, field).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_decoding_is_the_best_sequence():
    rng = np.random.default_rng(0)
    field = lines.LineField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, 3))

    def value(states):
        s = x @ field.weights
        return sum(s[t, y] for t, y in enumerate(states)) + sum(field.steps[a, b] for a, b in zip(states, states[1:]))

    best = max((tuple(map(int, f"{i:06b}")) for i in range(64)), key=value)
    assert tuple(field.decode(x).astype(int)) == best


def test_verdicts_follow_quality_outside_the_fit(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    outside = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 0"
    field = lines.fit_field(docs, labels.where(f"not {outside}"))
    got = {r.doc_id: r for r in lines.judge_lines(docs.where(outside), field).collect()}
    open_ones = [(r.quality, got[r.doc_id].kept) for r in labels.where(outside).collect() if not got[r.doc_id].base_failed]
    good = [k for q, k in open_ones if q]
    assert len(open_ones) > 80 and sum(good) >= 0.98 * len(good)
    assert sum(q == k for q, k in open_ones) >= 0.95 * len(open_ones)


def test_lines_of_mixed_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    outside = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 0"
    field = lines.fit_field(docs, labels.where(f"not {outside}"))
    assert field.steps[0, 0] + field.steps[1, 1] > field.steps[0, 1] + field.steps[1, 0]
    texts = docs.join(labels, "doc_id").where(outside).select("quality", "text").collect()
    long = re.compile(r"(?:\S+\s+){7}")
    plain = [x for r in texts if r.quality for x in r.text.split("\n") if long.match(x)][:200]
    marks = ("!! ", "### ", " | ")
    junk = [x for r in texts if not r.quality for x in r.text.split("\n") if any(x.count(m) > 2 for m in marks)][:200]
    assert len(plain) > 50 and len(junk) > 30
    hit = 0
    for i in range(0, 30, 3):
        parts = [(0, junk[i : i + 3]), (1, plain[i : i + 3]), (0, junk[-i - 3 :][:2])]
        states = [s for s, part in parts for _ in part]
        text = "\n".join(x for _, part in parts for x in part)
        hit += (field.decode(lines.described(text.encode())[1]) == np.array(states, dtype=bool)).sum() / len(states)
    assert hit > 9.5


def test_expected_states_meet_the_labels_shares():
    rng = np.random.default_rng(3)
    field = lines.LineField(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
    mask = np.ones((6, 5))
    mask[3, 3:] = 0
    sizes = rng.integers(1, 20, mask.shape) * mask
    y = np.array([0, 1, 0, 1, 0, 1])
    want, have = field._expected(rng.normal(size=(6, 5, 2)), mask, sizes, y)
    assert np.allclose(want.sum(axis=2), mask) and np.allclose(have.sum(axis=(2, 3)), mask[:, 1:])
    share = (want[..., 1] * sizes).sum(axis=1) / sizes.sum(axis=1)
    assert (share[y == 1] >= lines.GOOD_AT_LEAST - 1e-3).all() and (share[y == 0] <= lines.BAD_AT_MOST + 1e-3).all()


def test_line_fit_takes_odd_rows_and_long_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (2, None), (99, 1), (7, 3)], "doc_id long, quality int")
    field = lines.fit_field(odd_docs, labels, most_lines=2)
    assert lines.judge_lines(odd_docs, field).count() == odd_docs.count()
    assert lines.judge_lines(no_docs, lines.fit_field(no_docs, labels)).count() == 0
    many = spark.createDataFrame([(1, "\n".join(f"A plain line number {i} of text." for i in range(400))), (2, "!! A!! B!!\n" * 300)], "doc_id long, text string")
    fitted = lines.fit_field(many, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert {r.doc_id: r.content_words > 0 for r in lines.judge_lines(many, fitted).collect()} == {1: True, 2: False}
# --- MinHash ---------------------------------------------------------------------------------


def test_minhash_edits_and_likeness(spark, sample):
    docs = sample.limit(120)
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in minhash.compared_with_next(docs).collect()}

    def shingles(text):
        ws = words_of(text, True)
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    errors = []
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        third = len(r.text) // 3
        edited = r.text[: len(r.text) - third] + after[:third]
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(r.text), shingles(edited)
        errors.append(got[r.doc_id].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def _plain_fingerprint(text, bins=256):
    """Binned minima of shingle hashes, one shingle and one try after the other."""
    hashes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words_of(text, True)]
    least = [None] * bins
    for i in range(max(1, len(hashes) - 4)):
        h = 42
        for word in hashes[i : i + 5]:
            h = xxhash.xxh64(word.to_bytes(8, "little"), seed=h).intdigest()
        j, value = h >> 56, h & (1 << 40) - 1
        least[j] = value if least[j] is None else min(least[j], value)
    out = ""
    for i in range(bins):
        step, at = ((i * 0x9E3779B1) ^ (i >> 3) ^ 0x2545F491) % bins | 1, ((i * 0x85EBCA6B + 0x27D4EB2F) >> 7) % bins
        if least[i] is not None:
            at = i
        while least[at] is None:
            at = (at + step) % bins
        out += f"{least[at] & 15:x}"
    return out


def test_minhash_fingerprints_equal_plain_ones(spark, sample, odd_docs):
    """Every digit of both fingerprints and both likenesses, short, empty and long texts included."""
    docs = sample.limit(60).select("doc_id", "text").unionByName(
        odd_docs.where("doc_id is not null").selectExpr("doc_id + 1000000000 as doc_id", "text").dropDuplicates(["doc_id"])
    )
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in minhash.compared_with_next(docs).collect()}
    assert len(got) == len(rows)

    def likeness(a, b):
        return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))

    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        third = len(text) // 3
        own, edited = _plain_fingerprint(text), _plain_fingerprint(text[: len(text) - third] + after[:third])
        assert (got[r.doc_id].fingerprint, got[r.doc_id].edited_fingerprint) == (own, edited)
        assert got[r.doc_id].near_edited == pytest.approx(likeness(own, edited))
        assert got[r.doc_id].near_next == pytest.approx(likeness(own, _plain_fingerprint(after)))


def test_minhash_shuffles_whole_texts_once(spark, sample):
    df = minhash.compared_with_next(sample.limit(50))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_minhash_rows_without_doc_id_are_one_neighbour(spark):
    texts = [f"text number {i} of a row that has no id " * 3 for i in range(40)]
    rows = [(None, t) for t in [*texts, texts[0]]] + [(5, "the only named row here")]
    got = minhash.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 42 and sum(r.doc_id is None for r in got) == 41
    # The named row is next to all unnamed ones, and exactly one of their texts is next to it.
    start = "the only named row here"
    for r, t in zip(sorted((r for r in got if r.doc_id is None), key=lambda r: r.edited_sha256), sorted(
        hashlib.sha256((t[: len(t) - len(t) // 3] + start[: len(t) // 3]).encode()).hexdigest() for t in [*texts, texts[0]]
    )):
        assert r.edited_sha256 == t


def test_minhash_odd_rows(spark, odd_docs, no_docs):
    got = minhash.compared_with_next(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(len(r.fingerprint) == 256 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert minhash.compared_with_next(no_docs).count() == 0
    (alone,) = minhash.compared_with_next(odd_docs.where("doc_id = 8")).collect()
    assert alone.near_next == 1.0


# --- toxicity --------------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    rows = toxicity.word_rows([b"idiot", b"the", b"x", b"foo."])
    net = toxicity.ToxicityNet.new(1)
    net.weights = {k: v.astype(np.float64) * (3 if k in ("word", "char") else 1) for k, v in net.weights.items()}
    ids = rng.integers(0, 4, (4, toxicity.WINDOW))
    ids[0, 9:] = 4
    labels, weight = np.array([1, 0, 1, 0]), np.ones(4) / 4

    def loss():
        x = net.logits(net.projected(net.vectors(rows)), ids, 4).astype(np.float64)
        return (weight * (np.logaddexp(0, x) - labels * x)).sum()

    for name, grad in net.gradients(rows, ids, labels, weight).items():
        at, flat = np.abs(grad).argmax(), net.weights[name].reshape(-1)
        keep = flat[at]
        flat[at] = keep + 1e-2
        up = loss()
        flat[at] = keep - 1e-2
        down = loss()
        flat[at] = keep
        assert math.isclose(grad.reshape(-1)[at], (up - down) / 2e-2, rel_tol=2e-2, abs_tol=1e-5), name


def test_windows_overlap_and_cover():
    for n in (1, 24, 25, 40, 41, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + 24))} == set(range(n))
        assert all(b - a < 24 for a, b in zip(starts, starts[1:]))


def test_toxicity_of_held_out_and_odd_rows(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit_toxicity(docs, labels)
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), net).where(toxicity.held_out("doc_id", 5))
    rows = found.join(labels, "doc_id").select("toxic", "toxicity").collect()
    clean = np.array([r.toxicity for r in rows if r.toxic == 0])
    toxic = np.array([r.toxicity for r in rows if r.toxic == 1])
    assert np.mean(clean >= 0.5) < 0.03
    # Some 300 toxic texts to learn from; with 1,700 the area is 0.9997.
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.85
    odd = toxicity.score_toxicity(odd_docs, net).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.toxicity <= 1 for r in odd)
    assert all(r.toxicity < 0.5 for r in odd if r.text in (None, ""))
    assert toxicity.score_toxicity(no_docs, net).count() == 0
    empty_fit = toxicity.fit_toxicity(no_docs, labels)
    assert all(r.toxicity < 0.5 for r in toxicity.score_toxicity(odd_docs, empty_fit).collect())


def test_toxicity_learns_from_texts_of_a_thousand_words(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(160):
        words = list(rng.choice(plain, 1000))
        if i % 2:
            for at in rng.integers(0, 1000, 20):
                words[at] = "scoundrel"
        rows.append((i, " ".join(words), i % 2))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    scores = toxicity.Scorer(net).score([b"word1 word2 scoundrel word3", b"word1 word2 word7 word3"])
    assert scores[0] > max(toxicity.THRESHOLD, scores[1])


def test_words_numbered_in_spark_are_the_same_sample(spark, odd_docs):
    sample = odd_docs.where("text is not null").selectExpr("doc_id", "text", "1 toxic")
    words, ids, labels = toxicity.numbered(sample)
    want = [r.text.encode().lower().split() for r in sample.orderBy("doc_id", "text").collect()]
    assert [[words[i] for i in x] for x in ids] == want and labels.tolist() == [1] * len(want)
    assert words == sorted({w for t in want for w in t})


# --- WARC ------------------------------------------------------------------------------------


def test_records_skip_and_round_trip():
    digest = hashlib.sha1(b"<html>" * 300).hexdigest()
    body = warc.record_bytes("urn:page:1", "response", "http://a/ b", digest, 1800, None, b"<html>" * 300)
    body += warc.record_bytes("urn:page:2", "revisit", "", digest, 1800, "urn:page:1", None)
    got = list(warc.records(io.BytesIO(body)))
    assert got[0][1] == b"<html>" * 300 and got[0][0]["target_uri"] == "http://a/%20b"
    assert got[1][1] is None and got[1][0]["refers_to"] == "urn:page:1" and got[1][0]["payload_digest"] == digest
    only = list(warc.records(io.BytesIO(body), lambda v: v["record_type"] == "revisit"))
    assert [v["record_id"] for v, _ in only] == ["urn:page:2"]


def test_archives_with_filters_and_odd_pages(spark, tmp_path):
    big = "x" * 2000
    rows = [(1, "u", big), (5, None, big), (5, None, big), (None, "n", big), (2, "s", "small"), (3, "s", "small"), (4, "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.archived_pages(pages).collect(), key=repr)
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds[(1, "revisit", 5, 2000)] == 1 and kinds[(None, "revisit", 5, 2000)] == 1
    assert kinds[(5, "response", None, 2000)] == 2 and kinds[(4, "response", None, 0)] == 1
    assert kinds[(2, "response", None, 5)] == kinds[(3, "response", None, 5)] == 1
    assert warc.archived_pages(pages.where("false")).count() == 0
    warc.register(spark)
    path = str(tmp_path / "w")
    warc.page_records(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("payload", "skip").load(path)
    assert read.where("record_type = 'revisit'").count() == 2
    assert read.where("payload_length > 1000 and record_type in ('response')").count() == 2
    assert read.where("payload is not null").count() == 0


# --- SimHash ---------------------------------------------------------------------------------


def test_three_bits_meet_in_a_posting_list():
    assert len(simhash.COVERS) == 14
    for a in range(8):
        for b in range(a + 1, 8):
            for c in range(b + 1, 8):
                assert any(not {a, b, c} & set(s) for s in simhash.COVERS)


@pytest.mark.parametrize("tile", [4, 2048])
def test_components_match_all_pairs(spark, odd_docs, sample, tile):
    docs = sample.limit(400).select("doc_id", "text").unionByName(odd_docs.selectExpr("doc_id + 5000 as doc_id", "text"))
    near = docs.where("doc_id % 7 = 0").selectExpr("doc_id + 10000 as doc_id", "concat(text, ' extra') as text")
    got = simhash.near_duplicates(docs.unionByName(near), tile).collect()
    prints = np.array([r.fp for r in got], dtype=np.int64).astype(np.uint64)
    linked = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    ids = np.array([r.doc_id if r.doc_id is not None else 1 << 60 for r in got])
    label = ids.copy()
    while True:
        new = np.array([label[linked[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    assert [r.component_id if r.component_id is not None else 1 << 60 for r in got] == label.tolist()


def test_simhash_by_hand_and_keep_one(spark, odd_docs, no_docs):
    assert simhash.simhash(None) == simhash.simhash(b" \n") == 0
    import xxhash

    h = xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.simhash(b"One  TWO") & (2**64 - 1) == h
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 2
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


# --- SentencePiece ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return sentence_pieces.load_encoder(catalog.PIECES)


def test_same_likelihood_as_the_library(encoder, sample):
    model = sentencepiece_model_pb2.ModelProto()
    with open(catalog.PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, encoder.vocabulary.scores, strict=True):
        piece.score = float(score)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r.text for r in sample.limit(150).collect()]
    texts += ["", " a", "  b  c ", "\n\nx", "日本 🙂", "é" * 50, "x" * 3000, "\t\r\n"]
    ids, sizes = sentence_pieces.TaskEncoder(encoder).encode(texts)
    ends = np.cumsum(sizes)
    for text, end, size, other in zip(texts, ends, sizes, library.encode(texts), strict=True):
        mine = ids[end - size : end].tolist()
        assert encoder.decode(mine) == text
        if mine != other:  # the library adds in another order, so equal sums may fall otherwise
            value = encoder.vocabulary.scores.astype(float)
            assert math.isclose(value[mine].sum(), value[other].sum(), rel_tol=1e-5)


def test_encoding_of_odd_rows(spark, encoder, odd_docs, no_docs):
    encoded = sentence_pieces.encode_documents(odd_docs, encoder)
    rows = encoded.collect()
    assert len(rows) == odd_docs.count() and all(len(r.token_ids) == r.n_tokens for r in rows)
    texts = Counter(t[0] for t in sentence_pieces.decode_documents(encoded, encoder).select("text").collect())
    assert texts == Counter((r.text or "").replace("▁", " ") for r in odd_docs.collect())
    assert sentence_pieces.encode_documents(no_docs, encoder).count() == 0


# --- personal data ---------------------------------------------------------------------------


def brute_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m.group())) <= 15:
            found.append(("phone", m))
    found.sort(key=lambda x: (x[1].start(), pii.KINDS.index(x[0])))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


CASES = ["a@b.c@d.e x@y.z", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (569) 555-6633 4795326016703902", "é@x.y ü +49 30 1234567", "@a.b c@d", ""]


def test_base_spans(spark, sample):
    docs = sample.limit(300).select("doc_id", "text").union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(CASES)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs, pii.fit_spans(docs)).collect():
        assert r.base_spans == brute_spans(texts[r.doc_id])
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))


def test_added_spans_and_redaction(spark, sample, odd_docs, no_docs):
    more = spark.createDataFrame([(-1, 'x token = "0641917ea4e9feb9cda83477b57ac2654884f485" y'), (-2, "at +1 (569) 555-6633 4795326016703902")], "doc_id long, text string")
    model = pii.fit_spans(sample.select("doc_id", "text").union(more))
    got = {r.doc_id: r.spans for r in pii.find_personal_data(more, model).collect()}
    assert got[-1] == "secret:11:51" and "phone:3:20" in got[-2]
    clean = {r.doc_id: r for r in pii.redact_personal_data(odd_docs, model).collect()}
    assert clean[4].text is None
    assert any(r.text and "[EMAIL]" in r.text and r.n_chars == len(r.text) for r in pii.redact_personal_data(odd_docs, model).collect())
    assert pii.redact_personal_data(odd_docs, model).columns == odd_docs.columns
    assert pii.find_personal_data(no_docs, pii.fit_spans(no_docs)).count() == 0


# --- mixing ----------------------------------------------------------------------------------


def test_targets_by_steps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r for r in mixing.targets(mixing.source_weights(rows)).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert math.isclose(got[s].target, share.get(s, 3 * sizes[s]), abs_tol=1e-9) and got[s].weight == weight[s]


def test_mix_meets_targets_and_repeats_itself(spark, odd_docs, no_docs):
    rows = sorted(map(tuple, mixing.mix(odd_docs).collect()), key=repr)
    assert rows == sorted(map(tuple, mixing.mix(odd_docs.repartition(3)).collect()), key=repr)
    assert len(rows) == odd_docs.count() and all(r[4] <= 3 * r[1] for r in rows)
    taken, aims = Counter(), {}
    for r in rows:
        taken[(r[2], r[3])] += r[4]
        aims[(r[2], r[3])] = r[3]
    assert all(abs(taken[k] - aims[k]) <= 1.5 for k in aims if k[0])
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert sum(len(words_of(r.text)) for r in mixed.collect()) == sum(r[4] for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
