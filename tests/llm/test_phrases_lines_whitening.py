"""Phrases, line runs and whitening against brute force, on small tables with nulls, empty and long rows, ties, repeats."""

from __future__ import annotations

import collections
import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest

from telvane.llm import op11_phrase_stripes as op11
from telvane.llm import op12_line_runs as op12
from telvane.llm import op13_exact_whitening as op13

SCHEMA = "doc_id long, text string, lang string, n long, key string, at int, total long, gone string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, None, "x", 1, 5, "y") for r in rows], SCHEMA)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "CITY", "of", "the", "é", "ÀB", "state", "x", "hall", "a1", " "]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", " \n ", "\x0b", "\r\n"]
    out = []
    for _ in range(n):
        m = int(rng.integers(0, 60))
        out.append("".join(words[min(len(words) - 1, int(rng.exponential(3)))] + marks[int(rng.integers(len(marks)))] for _ in range(m)))
    return out


def awkward_rows():
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts(3, 150))]
    rows += [rows[0], rows[0], (None, None, None), (None, texts(4, 1)[0], "en"), (900, "", "en"), (901, "\n\n", "und"), (902, "new york city hall " * 3000, "en")]
    return rows


# --- phrases ----------------------------------------------------------------------------------------------------------

def phrases_by_hand(rows, longest, least, subsumed):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                part = lang, p[i:j]
                if j - i < len(p) and part in found and 100 * a >= subsumed * found[part]:
                    dropped.add(part)
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in dropped:
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out.append((lang, " ".join(p), len(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "share"), [(3, 10, 4096), (3, 3, 16), (4, 5, 4096), (2, 10, 4)])
def test_phrases(spark, monkeypatch, longest, least, share):
    monkeypatch.setattr(op11, "SHARE", share)  # low shares cut many prefixes into segments
    rows = awkward_rows()
    got = op11.mine_phrases(table(spark, rows), longest, least)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, longest, least, 50)


def test_phrases_of_small_batches_and_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(op11, "BATCH", 50)
    monkeypatch.setattr(op11, "BITS", 1 << 10)
    monkeypatch.setattr(op11, "text_parts", lambda a, f=op11.text_parts: f(a, 100))
    rows = awkward_rows()
    assert sorted(map(tuple, op11.mine_phrases(table(spark, rows)).collect())) == phrases_by_hand(rows, 3, 10, 50)


def test_first_phrases_of_each_language_and_ties(spark):
    rows = [(lang, f"w{i:03d} é", 2, 10 + i % 2, 20, 20, 99, 7 - i // 90) for lang in ("a", "b") for i in range(200)]
    found = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long")
    got = sorted((r["lang"], r["rank"], r["phrase"]) for r in op11.first_of_each(found, 50).collect())
    want = []
    for lang in ("a", "b"):
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[7], -r[3], r[1].encode()))[:50]
        want += [(lang, i + 1, r[1]) for i, r in enumerate(own)]
    assert got == want


def test_exact_scores_of_large_counts(spark):
    a, left, right = 9 * 10**14 + 7, 10**15 + 3, 10**15 + 9
    rows = spark.createDataFrame([(a, [left], [right])], "f long, lefts array<long>, rights array<long>")
    assert rows.select(op11.cut_scores("f", "lefts", "rights").alias("s")).first()["s"] == [10**6 * a * a // (left * right)]


def test_phrases_of_an_empty_table(spark):
    assert op11.mine_phrases(table(spark, [(1, None, None)]).limit(0)).collect() == []


# --- lines ------------------------------------------------------------------------------------------------------------

def lines_by_hand(rows, at_least, shortest):
    key = lambda line: lower(line.strip(op12.BLANKS))
    docs = collections.Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= shortest and docs[key(x)] >= at_least)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("at_least", "shortest", "batches", "fan"), [(10, 1, 4, 2), (2, 3, 7, 3), (5, 1, 1, 2), (3, 1, 9, 2)])
def test_lines(spark, at_least, shortest, batches, fan):
    rows = awkward_rows()
    got = op12.drop_repeated_lines(table(spark, rows), at_least, shortest, batches, fan).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_hand(rows, at_least, shortest)


def test_many_lines_in_one_text(spark):
    rows = [(i, "\n".join(f"Line {j} " if j % 2 else f"own {i} {j}" for j in range(20_000)), "en") for i in range(3)]
    got = op12.drop_repeated_lines(table(spark, rows), 3).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_hand(rows, 3, 1)


def test_batches_added_one_by_one(spark):
    """A store that lives on: after each batch its answer equals counting everything so far."""
    rows = awkward_rows()
    runs = op12.LineRuns(spark, 4)
    for i in range(0, len(rows), 40):
        runs.add(table(spark, rows[i : i + 40]))
        docs = collections.Counter(k for _, t, _ in rows[: i + 40] for k in {lower(x.strip(op12.BLANKS)) for x in (t or "").split("\n")} if k)
        assert runs.repeated().count() == sum(v >= 4 for v in docs.values())
    assert len(runs.levels) > 1 and runs.settled


def test_lines_of_an_empty_table(spark):
    assert op12.drop_repeated_lines(table(spark, [(1, None, None)]).limit(0)).collect() == []


# --- whitening --------------------------------------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n long, component string")


def whitened_by_hand(rows, count):
    """Double precision from the exact integer scatter."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    m = n * (x.T @ x) - np.outer(s, s)
    values, u = np.linalg.eigh(m.astype(float))
    order = np.argsort(-values)[:count]
    order = [k for k in order if values[k] > 1e-9 * values.max()]
    deviation = ((n * x - s) ** 2).sum(1)
    w = ((n * x - s) / n).astype(float) @ u[:, order] / np.sqrt(values[order] / n**2)
    return n, deviation, w, values[order] / values.sum()


@pytest.mark.parametrize(("width", "size", "count"), [(6, 80, 4), (12, 8, 32), (3, 50, 32)])
def test_whitening(spark, width, size, count):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.normal(size=width) * np.arange(1, width + 1) / 3).tolist()) for i in range(size)]
    rows += [rows[0], (None, rows[1][1])]
    bad = [(700, None), (701, [None] * width), (702, [float("nan")] * width), (703, [float("inf")] + [0.0] * (width - 1)), (704, [1.0]), (705, [])]
    got = op13.whiten(vectors(spark, rows + bad), count).collect()
    n, deviation, w, explained = whitened_by_hand(rows, count)
    k = w.shape[1]
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert got[0]["identity_error"] < 1e-9
    by = collections.defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    mine = np.array([[by[i, c][0]["whitened"] for c in range(1, k + 1)] for i, _ in rows])
    signs = np.sign((mine * w).sum(0))
    assert np.allclose(mine * signs, w, atol=1e-7)
    assert [by[i, 1][0]["deviation"] for i, _ in rows] == deviation.tolist()
    assert np.allclose([by[rows[2][0], c][0]["explained"] for c in range(1, k + 1)], explained, rtol=1e-9)
    assert len(by[rows[0][0], 1]) == 2


def test_no_vectors_and_no_spread(spark):
    assert op13.whiten(vectors(spark, [(1, None)])).collect() == []
    assert op13.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert op13.whiten(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []


def test_repeated_eigenvalues(spark):
    rows = [(i, [s if j == i % 3 else 0.0 for j in range(3)]) for i in range(3) for s in (1.0, -1.0)]
    got = op13.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-12
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 for r in got)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(2**30, 5), (-(2**29), 2**28), (17, -9), (2**31, 2**30)])]
    n, deviation, *_ = whitened_by_hand(rows, 2)
    got = {r["vec_id"]: r["deviation"] for r in op13.whiten(vectors(spark, rows)).collect()}
    assert got == {i: (d if d < 2**63 else None) for (i, _), d in zip(rows, deviation.tolist())}


def test_polynomial_and_roots_are_exact():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        y = rng.integers(-9, 9, (d + 3, d)).astype(object)
        if d > 2:
            y[:, 1] = y[:, 0]
        m = (y.T @ y).tolist()
        # Faddeev-LeVerrier by fractions.
        want, b = [Fraction(1)], np.zeros((d, d), object)
        for k in range(1, d + 1):
            b = np.array(m, object) @ b + want[-1] * np.eye(d, dtype=int).astype(object)
            want.append(-Fraction(sum((np.array(m, object) @ b)[i, i] for i in range(d))) / k)
        for p in (2**31 - 1, 101):
            assert op13.polynomial_modulo(m, p).tolist() == [int(c) % p for c in reversed(want)]
        roots = op13.largest_roots([int(c) for c in reversed(want)], d)
        values = np.sort(np.linalg.eigvalsh(np.array(m, float)))[::-1]
        got = [a / 2**s for a, s, k in roots for _ in range(k)]
        assert np.allclose(got, values[: len(got)]) and len(got) == np.linalg.matrix_rank(np.array(m, float))


def test_digests(spark):
    rows = awkward_rows()
    got = op12.drop_repeated_lines(table(spark, rows)).collect()
    assert {hashlib.sha256(r["text"].encode()).hexdigest() for r in got} == {hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in lines_by_hand(rows, 10, 1)}
