"""The n-gram model against its definition, and the bands that come from the corpus."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from fallpoint.llm import quality_rules
from fallpoint.llm.quality_rules import quality_rules as judge


def by_definition(codes):
    """Interpolated modified Kneser-Ney of order four over a list of codes, as a function of a tuple of four."""
    counts = {4: Counter(tuple(codes[k:k + 4]) for k in range(len(codes) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k, c):
        n = [sum(v == i for v in counts[k].values()) for i in range(1, 5)]
        i = min(c, 3)
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5  # small tables: the discount is then free to choose
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i
        return min(max(d, 0.1 * i), 0.95 * i)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 64
        after = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        own = max(counts[k][gram] - discount(k, counts[k][gram]), 0) if gram in after else 0
        return own / total + sum(discount(k, c) for c in after.values()) / total * p(gram[1:])

    return p


@pytest.mark.parametrize("seed", range(3))
def test_model_is_the_definition(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("abcde Z.", weights=[9, 7, 5, 3, 2, 6, 1, 1], k=500))
    packed = np.concatenate(list(quality_rules.grams(text)))
    p = by_definition([1, 1, 1] + [int(x) & 63 for x in packed])
    model = quality_rules.kneser_ney(*np.unique(packed, return_counts=True))
    unpacked = lambda g: tuple(int(g) >> s & 63 for s in (18, 12, 6, 0))
    other = np.array([rng.randrange(1 << 24) for _ in range(20)] + [int(g) ^ 3 for g in packed[:20]], dtype=np.uint32)
    for g in [*packed[:60], *other]:
        assert model.score(np.array([g], dtype=np.uint32)) == pytest.approx(math.log10(p(unpacked(g))), abs=2e-5)


def prose(rng, n, syllables=("the", "an", "re", "ing", "to", "er", "ou", "st")):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def junk(rng, n):
    return " ".join("".join(rng.choices("QXZJ#%9{}", k=5)) for _ in range(n))


def judged(spark, rows):
    return {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}


def test_junk_of_every_length(spark):
    rng = random.Random(8)
    lengths = [15, 30, 60, 150, 400, 1500]
    rows = [(i, prose(rng, rng.choice(lengths)), "en") for i in range(400)] + [(1000 + k, junk(rng, n), "en") for k, n in enumerate(lengths[1:])]  # at 15 words the limits hardly tell them apart
    got = judged(spark, rows)
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(400)) and not any(got[1000 + k]["kept"] for k in range(len(lengths) - 1))


def test_copies_do_not_narrow_a_band(spark):
    rng = random.Random(9)
    same = prose(rng, 100)
    different = [(i, prose(rng, 100), "en") for i in range(100)]
    got = judged(spark, different + [(1000 + i, same, "en") for i in range(400)])
    assert all(r["kept"] for r in got.values() if not r["base_failed"])


def test_tables_of_one_text_and_of_few(spark):
    rng = random.Random(10)
    one = prose(rng, 60)
    assert all(r["kept"] for r in judged(spark, [(i, one, None) for i in range(5)]).values())
    few = judged(spark, [(1, one, "en"), (2, None, "en"), (3, "", None), (4, "1 2 3 4 5 6 7 8 9 10 11", "xx")])
    assert few[1]["kept"] and not any(few[k]["kept"] for k in (2, 3, 4)) and few[4]["log_ppl"] is None


def test_languages_have_their_own_widths(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 100), "tight") for i in range(80)]
    rows += [(100 + i, prose(rng, 100, "the an re ing to er ou st qu zz xy KW".split()[:rng.randint(3, 12)]), "wide") for i in range(80)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rated = quality_rules.rated(data, quality_rules.fit_perplexity(data)).selectExpr("*", "lang as lang_key", "cast(floor(log2(n_runs)) as int) as length_class", "n_words < 10 as base_failed")
    width = {r["lang_key"]: r["high"] - r["low"] for r in quality_rules.perplexity_bands(rated).where("length_class = 6").collect()}
    assert width["wide"] > 1.5 * width["tight"]


def test_words_are_told_apart_and_counted_whole(spark):
    """Letters that share a class, and words that only the corpus knows: the verdict of the spelling alone would be the same."""
    rng = random.Random(12)
    known = ["".join(chr(0x430 + rng.randrange(32)) for _ in range(6)) for _ in range(60)]
    folded = ["".join(chr(ord(c) + 6 if ord(c) + 6 < 0x450 else ord(c) - 6) for c in w) for w in known]  # the same classes, other letters
    rows = [(i, " ".join(rng.choices(known, k=80)), "ru") for i in range(120)]
    same = rng.choices(range(60), k=80)
    rows += [(1000, " ".join(known[k] for k in same), "ru"), (1001, " ".join(folded[k] for k in same), "ru")]
    got = judged(spark, rows)
    assert got[1000]["kept"] and not got[1001]["kept"] and got[1001]["log_ppl"] > got[1000]["log_ppl"] + 0.5


@pytest.mark.parametrize("frequent", [0, 3, 40, 1 << 20])
def test_words_by_definition_whatever_goes_to_every_task(spark, frequent):
    rng = random.Random(13)
    texts = [" ".join(rng.choices(["la", "le", "un", "mot", "été", "x1", "Zoé"], weights=[9, 7, 5, 3, 2, 1, 1], k=rng.randint(1, 30))) + rng.choice(["", "  ", "\n"]) for _ in range(12)]
    texts += ["once only", " wide blank", "", " \t ", "la la", "퟿!"]
    data = spark.createDataFrame([(7 if i < 2 else i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = quality_rules.fit_perplexity(data, frequent=frequent)
    got = sorted((r["n_words"], r["n_runs"], r["log_ppl"]) for r in quality_rules.rated(data, model).collect() if r["n_runs"])
    counts = Counter(w for t in texts for w in t.encode().split())
    many = Counter(min(n, 5) for n in counts.values())
    y = many[1] / (many[1] + 2 * many[2]) if many[1] + many[2] else 0.5
    taken = [0.0] + [min(max(k - (k + 1) * y * many[k + 1] / many[k] if many[k] else 0.5 * k, 0.1 * k), 0.95 * k) for k in (1, 2, 3)]
    total = sum(counts.values())

    def log(text):
        out, at, runs = 0.0, 0, 0
        logs = [float(model.spelling.each(g)[k]) for g in quality_rules.grams(text) for k in range(len(g))]
        runs = sum(quality_rules.letter_runs(g) for g in quality_rules.grams(text))
        while at < len(text):
            stop = at
            while stop < len(text) and text[stop] not in " \t\n\v\f\r":
                stop += 1
            if stop == at:
                out += logs[at]
                at += 1
                continue
            rest = counts.copy()
            rest[text[at:stop].encode()] -= 1
            n = rest[text[at:stop].encode()]
            spelling = 10 ** sum(logs[at:stop + 1])
            out += math.log10((n - taken[min(n, 3)]) / (total - 1) + sum(taken[min(c, 3)] for c in rest.values()) / (total - 1) * spelling)
            at = stop + 1
        return len(text.encode().split()), runs, -out / runs if runs else None

    want = sorted(x for x in map(log, texts) if x[1])
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)
