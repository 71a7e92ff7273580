"""Each operator against brute force on small tables, and on awkward rows: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telvane.llm import (
    op1_skip_chain_pii as op1,
    op2_schema_fingerprints as op2,
    op3_language_filters as op3,
    op4_simhash_windows as op4,
    op5_adaptive_quality as op5,
    op6_signature_trees as op6,
    op7_two_stage_suffixes as op7,
    op8_context_mixing as op8,
    op9_temperature_mixing as op9,
    op10_prefix_shards as op10,
)
from telvane.llm.common import LEAST_FILES, Scratch
from telvane.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, words string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeioustrnl"), rng.integers(2, 7))) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, near copies, repeated rows, clashing names."""
    base, common = sentence(1, 120), sentence(2, 90)
    near = base.split()
    near[5] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n ", "a", sentence(3, 4000), common + " " + sentence(4, 60), sentence(5, 50) + " " + common, "12 34", "haha " * 300]
    rows = [(i, t, "xx" if i % 3 else None, "s0" if i % 2 else None, None, 0.5, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "other text under a used id", "xx", "s0", 1, 1.0, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "p", "q", "limit"), [(3, 9, 10, 250_000), (3, 9, 10, 300), (5, 4, 5, 250)])
def test_jaccard_components(spark, k, p, q, limit):
    rng, rows = np.random.default_rng(7), []
    for g in range(12):
        base = sentence(g, int(rng.integers(4, 90))).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = "w%d" % rng.integers(99)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    for _ in rows:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = op6.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, p, q, limit).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), label[i]) for i, s in sets.items()}


def test_linked_sets_share_a_part():
    rng, linked = np.random.default_rng(5), 0
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(0, 2**63, int(rng.integers(0, 2 + n // 12))).astype(np.uint64))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 10 * both >= 9 * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(op6.part_signatures(a, 9, 10), op6.part_signatures(b, 9, 10)))
    assert linked > 500


def test_parities_bound_the_differences():
    rng = np.random.default_rng(8)
    for _ in range(500):
        common = rng.integers(0, 2**63, int(rng.integers(0, 3000))).astype(np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64))) for _ in range(2))
        assert op6.fewest_differences(op6.parity(a), op6.parity(b)) <= len(np.setxor1d(a, b))


def test_texts_that_share_rare_phrases_are_not_read_again(spark, monkeypatch):
    """Texts that share a phrase of 40 words with each of seven others, most of each text, and two near copies."""
    pairs = {pair: sentence(500 + n, 40) for n, pair in enumerate(itertools.combinations(range(8), 2))}
    rows = [(i, " ".join(t for pair, t in pairs.items() if i in pair)) for i in range(8)]
    rows += [(8, sentence(7, 90)), (9, sentence(7, 90) + " more")]
    read, real = [], op6.with_texts

    def with_texts(wanted, docs):
        read.extend(r["doc_id"] for r in wanted.select("doc_id").collect())
        return real(wanted, docs)

    monkeypatch.setattr(op6, "with_texts", with_texts)
    got = op6.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: min(i, 8) for i, _ in rows}
    assert set(read) == {8, 9}


def test_components_of_few_edges_are_few_files(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(400).selectExpr("id AS a", "id - id % 5 AS b")
        found = components(edges, Scratch(spark, "few"))
        assert {(r["node"], r["label"]) for r in found.collect()} == {(i, i - i % 5) for i in range(400)}
        assert len(found.inputFiles()) <= LEAST_FILES
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repeated_bytes(spark):
    common = sentence(2, 200)
    texts = [common + sentence(3, 40), sentence(4, 30) + common[100:900], "ab" * 700, None, "", "x" * 399, "é" * 300, common[:399], sentence(9, 200), sentence(9, 200)]
    for limit in (4_000, 1):  # suffix sorting, and counting for crowded hashes
        got = op7.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=limit).collect()
        raw = {i: (t or "").encode() for i, t in enumerate(texts)}
        seen = collections.Counter(r[i : i + 400] for r in raw.values() for i in range(len(r) - 399))
        for r in got:
            data = raw[r["doc_id"]]
            gone = {j for i in range(len(data) - 399) if seen[data[i : i + 400]] > 1 for j in range(i, i + 400)}
            kept = bytes(b for j, b in enumerate(data) if j not in gone)
            spans = sum(j - 1 not in gone for j in gone)
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), len(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_order():
    rng = np.random.default_rng(3)
    for data in (rng.integers(97, 100, 300).astype(np.uint8), np.full(50, 97, np.uint8), np.arange(60, dtype=np.uint8)[::-1].copy()):
        whole = np.arange(len(data), dtype=np.uint64)
        order = op7.suffix_order(data, np.ones(len(data), bool), 1000, whole).tolist()
        assert order == sorted(range(len(data)), key=lambda i: data[i:].tobytes())


def test_quality_counts(spark):
    df, rows = awkward(spark)
    got = sorted(map(tuple, op5.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    expected = []
    for i, t, *_ in rows:
        t = t or ""
        w, seen, again = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        n = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {x for j in range(len(w) - 4) if n[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert got == sorted(expected, key=str)


def test_quality_bucket_values_rise(spark):
    rows = spark.range(5000).select(op5.bucket(F.col("id")).alias("b"), "id").select("b", "id", op5.bucket_value(F.col("b")).alias("v")).orderBy("id").collect()
    assert all(x["b"] <= y["b"] for x, y in zip(rows, rows[1:])) and all(0 <= r["id"] - r["v"] <= r["id"] / 16 for r in rows)


def test_personal_data(spark):
    text = "mail ann.b7@site.example.org or +1 (974) 555-3436, 4031065727380220 and 1.2.3.400 1.2.3.4.5; later ann.b7 again"
    df = spark.createDataFrame([(1, text), (2, None), (3, "clean words only"), (4, "9" * 5000), (5, "@" * 50 + "a" * 5000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in op1.find_personal_data(df).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_phone"]) == (1, 1, 1)
    base = [tuple(x) for k in op1.KINDS for x in op1.base_spans(text)[k]]
    spans = {tuple(map(int, s.split(":")[1:])) for s in rows[1]["spans"].split(",")}
    assert set(base) <= spans
    assert all(rows[i]["spans"] == "" and rows[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in (2, 3))


def test_ties_spread_labels():
    text = "x@y.org a.bc9 zz a.bc9@site.org and a.bc9"
    tokens = op1.Tokens(text, op1.base_spans(text))
    assert len(tokens.ties) == 2  # the name before the @ is tied to its other mentions
    field = op1.Field({}, np.ones((5, 5)), np.full(5, 0.2))
    assert (field.beliefs(tokens).argmax(axis=1) == 1).all()


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l \\e \\<|im_end|>", "", None, "a\nb <|im_start|>user\n", "[/INST]\\", "é<|x|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (2, None, "assistant", "y"), (2, None, "assistant", "y")]
    got = {r["conv_id"]: r for r in op2.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 3
    turns = "".join(f"{'assistant' if i % 2 else 'user'}\n{t or ''}\n" for i, t in enumerate(texts))
    loss = "".join(t or "" for t in texts[1::2])
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (
        len(texts), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 2


def test_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '{"prompt":"p","response":"r"}', '{"instruction":"i","input":"","output":"o"}',
               '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"unknown":1}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, json string")
    got = [[tuple(t) for t in r["turns"] or []] for r in op2.with_turns(df, F.parse_json("json")).orderBy("id").collect()]
    assert got == [[("user", "hi"), ("assistant", "yo")], [("user", "p"), ("assistant", "r")], [("user", "i"), ("assistant", "o")], [("user", "a"), ("assistant", "b")], []]


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = op3.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)
    df, _ = awkward(spark)
    by_text = {(r["doc_id"], r["lang_pred"]) for r in op3.identify_languages(df).collect()}
    assert {(4, "und"), (5, "und"), (10, "und"), (7, "xx")} <= by_text


def test_leaks(spark):
    item = sentence(11, 30)
    changed = item.split()
    changed[29] = "other"
    docs = [(1, sentence(1, 80) + " " + item.upper() + "!! " + sentence(2, 50)), (2, sentence(3, 100)), (3, " ".join(changed)), (4, None), (5, ""), (1, "same id, clean"), (6, item[: len(item) // 2])]
    items = [(7, item), (8, "too short"), (9, None), (7, item)]
    got = {(r["doc_id"], r["contaminated"], r["best_item"]) for r in op4.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, True, 7), (2, False, None), (3, True, 7), (4, False, None), (5, False, None), (1, False, None), (6, False, None)}


def test_leaks_against_all_starts(spark):
    def pieces(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    items = {1: sentence(21, 60).split(), 2: sentence(22, 40).split(), 3: sentence(23, 6).split()}
    items[4] = items[1][:30] + sentence(24, 30).split()
    item, left, right = items[1], sentence(25, 40).split(), sentence(26, 40).split()
    docs = [item[1:], item[:-1], item[:29] + item[30:], item[:30] + item[32:], item[:-3], item[5:]]
    docs += [left + d + right for d in docs] + [left + item[:-k] for k in (3, 4, 5, 6)] + [item[k:] + right for k in (3, 4, 5, 6)]
    docs += [left + item[4:] + right + items[2][:-2], item + item[:30] + item, left + items[3] + right, items[3][:-1], left + right, items[4][2:] + item[:-2]]
    df = collections.Counter(x for w in items.values() for x in pieces(w))
    weight = {x: round(1000 * math.log(1 + len(items) / n)) for x, n in df.items()}
    want = {}
    for d, words in enumerate(docs):
        found = []
        for i, w in items.items():
            for start in range(max(0, len(words) - len(w)) + 1):
                a, b = pieces(words[start : start + len(w)]), pieces(w)
                total = [sum(weight.get(x, round(1000 * math.log(1 + len(items)))) for x in s) for s in (a & b, a | b)]
                if total[0] >= 0.8 * total[1]:
                    found.append((-total[0] / total[1], i))
        want[d] = (len({i for _, i in found}), min(found)[1], round(-min(found)[0], 9)) if found else (0, None, None)
    assert sum(n > 0 for n, _, _ in want.values()) > 15
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    got = op4.find_leaks(rows, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_items"], r["best_item"], r["best_similarity"] and round(r["best_similarity"], 9)) for r in got} == want


def test_context_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    words = {i: [*WORD.findall(lower(t)), "\n"] for i, t in texts.items()}
    counts = collections.Counter(x for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    total = sum(counts.values())
    for r in op8.score(docs).collect():
        w = words[r["doc_id"]]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert abs(base - r["base_score"]) < 1e-6 * max(1, abs(base))
        assert r["score"] == 0 if not texts[r["doc_id"]] else r["bits_per_byte"] < 8


def test_context_mixing_state(spark, monkeypatch):
    """The state runs on through a text, over pieces too, and its start is fitted on all training texts."""
    rng = np.random.default_rng(3)
    code = op8.Code(rng.integers(0, 1000, 1 << 16))
    odds, few = np.zeros(1 << 21, np.int8), np.zeros(1 << 21, np.uint8)
    data = np.frombuffer(sentence(31, 1500).encode()[:4096], np.uint8)
    since = op8.since_start(np.array([0, 4096]))
    bits = op8.Bits(code, op8.pairs(data, since))
    for h in op8.contexts(data, since):  # right, but timid: weights must grow
        odds[op8.slots(np.repeat(h, bits.length), bits.node, 21)] = np.where(bits.control & 1, 8, -8)
    model = op8.Model(code, odds, few, op8.first_state())
    parts = [op8.score_texts(model, data[:n], np.array([0, n]))[0] for n in (1024, 2048, 4096)]
    assert parts[2] - parts[1] > 2 * parts[0] * 0.95  # the second half costs less than its share
    together = op8.score_texts(model, np.r_[data, data[:100]], np.array([0, 4096, 4096, 4196]))
    assert abs(together[0] - parts[2]) < 1e-3 and together[1] == 0
    monkeypatch.setattr(op8, "PART", 1500)
    assert abs(op8.score_texts(model, data, np.array([0, 4096]))[0] / parts[2] - 1) < 0.01

    fitted_on = []
    monkeypatch.setattr(op8, "fit_state", lambda docs, model: fitted_on.append(docs.count()) or model.state)
    op8.learn(spark.createDataFrame([(i, "some words") for i in range(900)], "doc_id long, text string"), np.ones(1 << 16, np.int64), 16)
    assert fitted_on == [900]


def test_context_mixing_fit():
    """A gate's weights are the optimum of its cells; own bits are left out of their features; the table grows with the tokens."""
    rng = np.random.default_rng(4)
    cell = np.unique(rng.integers(0, 2 * op8.LEVELS**3, 400))
    n, start = rng.integers(1, 50, len(cell)), np.array([0.2, 0.3, 0.6])
    w, bits, ones = op8.fit_gate(cell, n, start)
    levels = np.stack([cell // 1024 % 32, cell // 32 % 32, cell % 32])
    x, y = (levels * 8 + 3.5 - 128) / op8.STEP, cell // 32**3
    assert np.abs(x @ (n * (y - 1 / (1 + np.exp(-w @ x)))) - (w - start)).max() < 1e-5
    assert bits.sum() == n.sum() and ones.sum() == n[y == 1].sum()

    code, data = op8.Code(np.ones(1 << 16)), np.frombuffer(sentence(8, 300).encode(), np.uint8)
    since, counts = op8.since_start(np.array([0, len(data)])), np.zeros((1 << 18, 2), np.int64)
    b = op8.Bits(code, op8.pairs(data, since))
    at = [op8.slots(np.repeat(h, b.length), b.node, 18) for h in op8.contexts(data, since)]
    for a in at:
        np.add.at(counts, (a, b.control & 1), 1)
    odds = lambda n: np.clip(np.round(op8.STEP * np.log((n[..., 1] + 0.4) / (n[..., 0] + 0.4))), -127, 127)
    model = op8.Model(code, odds(counts).astype(np.int8), (np.minimum(counts[:, 0], 15) << 4 | np.minimum(counts[:, 1], 15)).astype(np.uint8), op8.first_state())
    got = model.features(data, since, 0, model.without_own())[0].view(np.int8).reshape(-1, 4)
    for k, a in enumerate(at):
        less = counts[a] - np.eye(2, dtype=np.int64)[b.control & 1]
        assert np.abs(got[:, k] - odds(less)).max() <= 2
    few = less.sum(axis=1)
    assert ((got[:, 3].view(np.uint8) >> 1 & 3 == np.minimum(3, np.ceil(np.log2(few + 1) / 2))) | (counts[a] >= 15).any(axis=1)).all()
    assert [op8.table_bits(n) for n in (0, 10_000, 10_000_000)] == [16, 19, 23]
    assert op8.stride_at(0) == op8.STRIDE and op8.stride_at(op8.EARLY * 4) == 4 * op8.STRIDE


def test_context_mixing_folds_equal_contexts(monkeypatch):
    """Bytes with equal contexts are worked out once, with the features each has by itself; texts go by length, none is lost."""
    text = (sentence(5, 400) + " ") * 3
    data, rng = np.frombuffer((text + "\x00" + sentence(6, 90) + text).encode(), np.uint8), np.random.default_rng(6)
    code, offsets = op8.Code(rng.integers(0, 1000, 1 << 16)), np.array([0, 3, 3, len(text), len(text) + 1, len(data)])
    since = op8.since_start(offsets)
    model = op8.Model(code, rng.integers(-127, 128, 1 << 16).astype(np.int8), rng.integers(0, 256, 1 << 16).astype(np.uint8), op8.first_state())
    all_bits, found = op8.Bits(code, op8.pairs(data, since)), op8.contexts(data, since)
    want = np.stack([model.odds[op8.slots(np.repeat(h, all_bits.length), all_bits.node, 16)] for h in found], 1)
    monkeypatch.setattr(op8, "PIECE", 1 << 12)
    got, starts = model.features(data, since, 0)
    assert (got.view(np.int8).reshape(-1, 4)[:, :3] == want).all() and (starts == all_bits.start).all()
    folded, _, number = op8.distinct_bits(code, data, since, 0)
    assert len(folded.control) < len(all_bits.control) / 2 and len(number) == len(data)

    texts = [None, "", "a", text, "b" * 3000, None, "c" * 9000, "d" * 2000]
    monkeypatch.setattr(op8, "PART", 4000)
    monkeypatch.setattr(op8, "TOGETHER", 5000)
    seen = {}
    for ids, part, bounds in op8.by_length(pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts})):
        assert len(ids) == 1 or len(part) <= 5000
        seen |= {i: part[a:b].tobytes().decode() for i, a, b in zip(ids.to_pylist(), bounds[:-1], bounds[1:])}
    assert seen == {i: t or "" for i, t in enumerate(texts)}


def test_huffman_code_is_complete():
    code = op8.Code(np.random.default_rng(1).integers(0, 1000, 1 << 16))
    assert np.allclose((2.0 ** -code.length).reshape(256, 256).sum(axis=1), 1)


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "hot" if i % 10 else f"s{i % 3}") for i in range(3000)] + [(1, "w w", "hot"), (None, None, None), (4, "", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = collections.Counter(r["source"] for r in op9.mix(df, repeats=2.0).collect())
    have = collections.Counter(r[2] for r in rows)
    assert copies["hot"] == have["hot"] and all(have[s] < copies[s] <= 2 * have[s] for s in ("s0", "s1", "s2")) and copies[None] == 1
    out = op9.mix(df, entropy=1.2, budget=2000.0)
    spent = {r["source"]: (r["spent"], r["mix_budget"]) for r in out.withColumn("t", op9.tokens(F.col("text"))).groupBy("source").agg(F.sum("t").alias("spent"), F.first("mix_budget").alias("mix_budget")).collect()}
    assert all(0 <= a - b < 5 for s, (a, b) in spent.items() if s)
    weights = np.array([b for s, (_, b) in spent.items() if s]) / sum(b for s, (_, b) in spent.items() if s)
    assert abs(-(weights * np.log(weights)).sum() - 1.2) < 0.01


def test_mixing_budget_ends_on_a_block_border(spark):
    df = spark.createDataFrame([(i, "w", "s") for i in range(600)], "doc_id long, text string, source string")
    blocks = collections.Counter((r["mix_group"], r["mix_block"]) for r in op9.mix(df, repeats=2.0).collect())
    first = blocks[min(blocks)]
    assert len(blocks) == 3
    assert op9.mix(df, repeats=2.0, budget=600.0 + first).count() == 600 + first


def test_shards(spark):
    df, rows = awkward(spark)
    out = op10.shard(op10.sized(df), 4).collect()
    assert len(out) == len(rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in out)
    assert all(abs(sizes[s] - sum(sizes.values()) / 4) <= largest for s in range(4))


def test_awkward_rows_and_empty_tables(spark):
    df, rows = awkward(spark)
    items = spark.createDataFrame([(1, sentence(2, 90))], "item_id long, text string")
    for table, n in ((df, len(rows)), (df.limit(0), 0)):
        assert op1.find_personal_data(table).count() == n
        assert op3.identify_languages(table).count() == n
        assert op4.find_leaks(table, items).count() == n
        assert op5.judge(table).count() == n
        assert op6.jaccard_components(table).count() == n
        assert op7.remove_repeats(table).count() == n
        assert op8.score(table).count() == n
        assert op9.mix(table, repeats=2.0).filter("mix_copy = 1").count() == n
        assert op10.shard(op10.sized(table), 16).count() == n


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["near_copies"](spark, docs, sf)
    assert kept.columns == columns and kept.count() < docs.count()
    clean = stages["decontamination"](spark, docs, sf).collect()
    assert not [r for r in clean if any(len(WORD.findall(i["text"])) >= 5 and i["text"] in (r["text"] or "") for i in items)]
    assert stages["language_id"](spark, docs, sf).count() >= 0.95 * docs.count()
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert stages["sharding"](spark, mixed, sf).count() == mixed.count()
