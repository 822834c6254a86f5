"""Near copies held against all pairs of texts."""

import random

import pytest

from fallpoint.llm import simhash
from tests.llm.test_text_ops import plain_fingerprint


def plain_survivors(rows):
    """Smallest id of each component of all pairs within two bits or of Jaccard similarity 0.8."""
    prints = [plain_fingerprint(t) for _, t in rows]
    sets = []
    for _, t in rows:
        words = t.lower().split()
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 2 or common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return set(least.values())


def survivors(spark, rows):
    kept = simhash.near_representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r["doc_id"] for r in kept.collect()}


WORDS = [f"w{k}" for k in range(5000)]


def changed(rng, base, n):
    out = list(base)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(WORDS)
    return out


@pytest.mark.parametrize("length, changes", [(300, 3), (300, 6), (100, 2), (1000, 20), (45, 1), (20, 1)])
def test_no_similar_pair_is_missed(spark, length, changes):
    rng, texts = random.Random(length + changes), []
    for _ in range(40):
        base = rng.choices(WORDS, k=length)
        texts += [base, changed(rng, base, changes), base[:length - length // 10]]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(i, " ".join(t)) for i, t in zip(order, texts)]
    want = plain_survivors(rows)
    assert len(want) < 110 and survivors(spark, rows) == want


def test_links_between_followers_are_found(spark):
    """Chains in which most are too far from any one leader, and texts that share a long passage only."""
    rng, texts = random.Random(3), []
    passage = rng.choices(WORDS, k=120)
    for _ in range(6):
        text = rng.choices(WORDS, k=200)
        for _ in range(25):
            texts.append(text)
            text = changed(rng, text, 4)
    texts += [rng.choices(WORDS, k=60) + passage + rng.choices(WORDS, k=rng.randrange(5, 60)) for _ in range(40)]
    texts += [passage + rng.choices(WORDS, k=k) for k in range(1, 30)]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(i, " ".join(t)) for i, t in zip(order, texts)]
    assert survivors(spark, rows) == plain_survivors(rows)


def test_order_of_hot_shingles_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SAMPLE", 1)
    monkeypatch.setattr(simhash, "HOT_TIMES", 2)
    test_links_between_followers_are_found(spark)


def test_repeated_ids_link_nothing(spark):
    """One id with two unlike texts; two null ids with texts that differ by a capital sign only."""
    rng = random.Random(6)
    one, two, three = (" ".join(rng.choices(WORDS, k=80)) for _ in range(3))
    data = spark.createDataFrame([(1, one), (1, two), (2, one.upper()), (None, three), (None, three.upper())], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.near_representatives(data).collect()]
    assert len(kept) == 3 and {one, two} <= {t for _, t in kept} and sorted(i or 0 for i, _ in kept) == [0, 1, 1]


@pytest.mark.parametrize("large", [2, 64])
def test_divided_groups_lose_no_link(spark, monkeypatch, large):
    """Changed copies of one text, most too far from each other: groups are divided, their texts do not all meet."""
    rng, met, likely = random.Random(12), [], simhash.likely
    monkeypatch.setattr(simhash, "LARGE", large, raising=False)
    monkeypatch.setattr(simhash, "likely", lambda matches, least: (met.append(matches.count()), likely(matches, least))[1])
    base = rng.choices(WORDS, k=150)
    texts = [changed(rng, base, rng.choice((1, 2, 3, 4))) for _ in range(220)]
    texts += [changed(rng, t, 1) for t in texts[:20]] + [t[:rng.randrange(100, 150)] for t in texts[:30]] + [rng.choices(WORDS, k=40) + base for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in zip(rng.sample(range(len(texts)), len(texts)), texts)]
    want = plain_survivors(rows)
    assert 20 < len(want) < 250 and survivors(spark, rows) == want
    assert met[-1] < 40_000  # 200 thousand and more where every text of a shared shingle met every other


def test_small_groups_divided_keep_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 2)
    test_links_between_followers_are_found(spark)
