"""Prefix trie, whitening and repeated passages held against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallpoint.llm import prefix_trie as trie
from fallpoint.llm import substring_dedup as passages
from fallpoint.llm import whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows, **sizes):
    data = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int").repartition(3)
    return trie.prefix_trie(*trie.borrowed_prefixes(data), **sizes)


def conversations(n, seed, texts=("hi", "hello", "", None, "so é🙂", "bye")):
    rnd = random.Random(seed)
    return [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(texts))
            for c in (rnd.sample(range(-150, 700), n)) for t in range(rnd.choice([1, 2, 3, 5, 9]))]


@pytest.mark.parametrize("seed", range(2))
def test_trie_is_that_of_brute_force(spark, seed):
    rows = conversations(150, seed)
    rows += [(r[0] + 10_000, *r[1:]) for r in rows[:200]] + rows[:3] + [(None, 1, "user", "no id")]
    got = trie_of(spark, rows, band=2 + seed, convs=30, listed=3).collect()
    assert {tuple(r) for r in got} == brute_trie(rows) and len(got) == len(brute_trie(rows))


def test_trie_of_a_long_conversation_and_many_equal_ones(spark):
    same = [(100 * c, t, "user", f"t{t}") for c in range(400) for t in range(3)]
    rows = same + [(7, t, "user", f"long {t % 3}" + "x" * (100_000 if t == 5 else 0)) for t in range(700)]
    assert {tuple(r) for r in trie_of(spark, rows).collect()} == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, [(None, 1, "user", "x")]).count() == 0
    assert trie_of(spark, [(None, 1, "user", "x")]).where("false").count() == 0


# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<float>, component string, n double").repartition(3)


def brute_whitening(rows):
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(dims)]
    gap = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(dims)] for _, x in good])
    values, vectors_ = np.linalg.eigh(gap.T @ gap / n)
    far = [sum((n * x[j] - sums[j]) ** 2 for j in range(dims)) for _, x in good]
    return good, n, gap, values[::-1], vectors_[:, ::-1], far


@pytest.mark.parametrize("dims, k", [(12, 8), (3, 3), (1, 1)])
def test_whitening_is_that_of_the_plain_eigenvectors(spark, dims, k):
    rnd = np.random.default_rng(dims)
    rows = [(i, [float(np.float32(v)) for v in rnd.normal(size=dims) * (1 + np.arange(dims)) + 3]) for i in range(300)]
    odd = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)), (904, [])]
    rows += [rows[0]] * 200 + [(None, rows[1][1])]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    good, n, gap, values, basis, far = brute_whitening(rows)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    want = defaultdict(list)
    for (i, _), g, f in zip(good, gap, far):
        want[i].append((f, g))
    for r in got:
        f, g = want[r["vec_id"]][0]
        j = r["component"] - 1
        assert int(r["deviation"]) == f
        assert abs(abs(r["whitened"]) - abs(g @ basis[:, j]) / math.sqrt(values[j])) < 1e-8
        assert abs(r["explained"] - values[j] / values.sum()) < 1e-12
        assert r["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    none = whitening.whiten(vectors(spark, [(1, None), (2, [])]))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "component", "n"]
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(flat) == 4 and {(r["whitened"], r["explained"], r["deviation"]) for r in flat} == {(0.0, 0.0, 0)}
    short = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [5.0, 2.5]), (3, [1.0])])).collect()
    assert {r["vec_id"] for r in short} == {1, 2} and {r["component"] for r in short} == {1, 2}
    large = whitening.whiten(vectors(spark, [(i, [1e9 * i, float(i * i)]) for i in range(1, 9)])).collect()
    assert max(int(r["deviation"]) for r in large) > 2 ** 63


def test_components_of_equal_and_spread_values():
    rnd = np.random.default_rng(5)
    q = np.linalg.qr(rnd.normal(size=(40, 40)))[0]
    for values in ([5.0] * 40, [7.0] * 13 + [2.0] * 20 + [0.0] * 7, list(10.0 ** np.linspace(8, -8, 40)), list(np.linspace(1, 1 + 1e-9, 40))):
        a = (q * values) @ q.T
        found, basis = whitening.spectral_components((a + a.T) / 2)
        assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * max(values)
        assert np.abs(basis.T @ basis - np.eye(40)).max() < 1e-13
        assert np.abs(a @ basis - basis * found).max() <= 1e-13 * max(values)


# ---------------------------------------------------------------- repeated passages


def brute_passages(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check_passages(spark, texts, window=35, seed=12):
    data = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row int, content string").repartition(3)
    got = {r["doc_id"]: r for r in passages.substring_dedup(data, window=window, seed=seed).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_passages(texts, window)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == want, i
        assert sum(s["words"] for s in got[i]["repeats"]) == want[1]


def mosaics(rnd, n, vocabulary):
    """Texts that share stretches of all lengths, at places of their own."""
    pool = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 120))] for _ in range(25)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            words += p[a:a + rnd.randrange(1, 100)] + [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))]
        out.append(rnd.choice([" ", "\n", "\t ", "  "]).join(words))
    return out


@pytest.mark.parametrize("kinds, window, seed", [(5000, 35, 12), (2, 10, 4), (3, 7, 7), (40, 12, 1)])
def test_passages_are_those_of_brute_force(spark, kinds, window, seed):
    rnd = random.Random(kinds)
    vocabulary = [f"w{i}é" for i in range(kinds)]
    texts = mosaics(rnd, 150, vocabulary)
    texts += texts[:20] + [None, "", " \n\t", "a", " ".join(["a"] * 200), " ".join(["a", "b"] * 100), "x" * 50_000]
    texts += [" ".join([f"own{k}"] + vocabulary[:3] * 30 + [f"tail{k}"]) for k in range(60)]
    check_passages(spark, texts, window, seed)


def test_passages_of_long_texts_in_pieces(spark):
    rnd = random.Random(1)
    vocabulary = [f"word{i}" for i in range(9000)]
    shared = " ".join(rnd.choice(vocabulary) for _ in range(400))
    long = " ".join(rnd.choice(vocabulary) for _ in range(40_000))
    texts = [long + " " + shared, shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(30_000)), long[200_000:], "y" * 3_000_000 + " " + shared,
             " ".join(["ab"] * 100_000)]
    check_passages(spark, texts)


def test_pieces_cover_a_text_with_its_overlap():
    rnd = random.Random(2)
    for size in (1, 7, 50, 10_000):
        text = " ".join("w" * rnd.randrange(1, 12) for _ in range(300)).encode() + b"  "
        words, whole = text.split(), list(passages.pieces(text, 6, size))
        assert [w for k, (_, p) in enumerate(whole) for w in p.split()[6 if k else 0:]] == words
        assert all(words[first:first + len(p.split())] == p.split() for first, p in whole)


def test_passages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.substring_dedup(docs).count() == 0
