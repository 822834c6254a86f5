"""The text operators held against plain definitions, on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fallpoint.llm import bpe, chat_format, cotraining, exact_dedup, html_extract, language_id, packing, pii, quality_rules, simhash
from fallpoint.llm.components import components

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"word{i % 97} and{i}" for i in range(20_000))
TEXTS = [None, "", " \n\t ", "same text here", "same text here", "Same text here", "a", "#### !!! 12", LONG, LONG + " end", "x" * 30_000,
         "tab\tand\nlines\n\nlines\nlines", "É è ß 漢字 🙂 мир", "<|endoftext|> stays <|startoftext|>", "one two three four five six one two three four five six"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src", 0, "clash", i) for i, t in enumerate(TEXTS)]
    rows += [(3, "same text here", "en", "src", 0, "clash", 1), (None, "no id", None, None, None, None, None), (None, "same text here", "en", "s", 1, "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, head string, fp long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(odd, empty, keep):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    best = {}
    for i, t in rows:
        if i is not None:
            best[t] = i if t not in best else (min if keep == "smallest" else max)(best[t], i)
    size = Counter(t for _, t in rows)
    got = exact_dedup.exact_dedup(odd, keep=keep).collect()
    want = Counter((i, best.get(t), size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(size)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_hot_group_over_many_ranges(spark):
    data = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact_dedup.exact_dedup(data).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] % 3 < 2} == {(0, 2000)}
    assert sum(r["kept"] for r in got) == 51


def test_exact_dedup_compares_normalised_texts(odd):
    got = by_id(exact_dedup.exact_dedup(odd.where("doc_id in (4, 5)"), normalise=F.lower("text")))
    assert got[5]["keep_id"] == 4 and got[5]["group_size"] == 2


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    import xxhash
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_fingerprints(odd, empty):
    got = simhash.simhash_dedup(odd).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r["doc_id"], f"{plain_fingerprint(r['text']):016x}") for r in odd.collect())
    groups = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert groups[0] == groups[1] == groups[2] == 0 and groups[3] == groups[4] == groups[5] == 3 and groups[9] == 8
    assert simhash.simhash_dedup(empty).count() == 0


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = []
    for b in base:
        for _ in range(rng.randint(1, 12)):
            x = b
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints += [0, 0, 1, 3, 7, (1 << 63) | 7, (1 << 64) - 1]
    order = list(range(len(prints)))
    rng.shuffle(order)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in zip(order, prints)]
    group = {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if ((rows[a][1] ^ rows[b][1]) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                group[y] = x
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i, _ in rows}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_representatives(odd, empty):
    kept = simhash.near_representatives(odd)
    assert kept.columns == odd.columns
    texts = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i, _ in texts] == [0, 3, 6, 7, 8, 10, 11, 12, 13, 14]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["no id"]
    assert simhash.near_representatives(empty).count() == 0


def test_wider_search_links_similar_texts_only(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    rows, base_of = [], {}
    for g in range(30):
        base = rng.choices(words, k=300)
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(300)] = rng.choice(words)
            base_of[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.near_representatives(data).collect()}
    narrow = {r["doc_id"] for r in simhash.near_representatives(data, wider=False).collect()}
    assert {base_of[i] for i in kept} == set(range(30)) and all(min(i for i in kept if base_of[i] == g) == 4 * g for g in range(30))
    assert len(kept) <= 48 and kept < narrow and len(narrow) >= 60


def test_bpe_round_trip(odd, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_BPE)
    back = bpe.decode(bpe.encode(odd, BYTE_BPE), BYTE_BPE)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["text"], r["head"]) for r in back.collect())
    want = Counter()
    for r in odd.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], tuple(ids), own.decode(ids, skip_special_tokens=False), r["head"])] += 1
    assert got == want
    assert bpe.decode(bpe.encode(empty, BYTE_BPE), BYTE_BPE).count() == 0


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    own, codec, rng = Tokenizer.from_file(BYTE_BPE), bpe.Codec(BYTE_BPE), random.Random(2)
    parts = ["a", "the", "'s", " ", "  ", "\n", "\t", "é", "1", "!!", "<|endoftext|>", " ", "漢", "🙂", "\x1c", "\r\n", "z" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)] + [" " * 200, "ab" * 2000]
    for t, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == own.encode(t, add_special_tokens=False).ids
        assert codec.decode(ids.tolist()) == t
    assert codec.decode([codec.of_byte[0xff], 10 ** 9]) == "�"


def check_pieces(rows, docs, window):
    """Every id once, in place; returns the padding."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, t in docs:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    by_sequence, parts = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    got = Counter()
    while parts:
        i, total, _ = key = next(k for k in parts if k[2] == 0)
        data, at = b"", 0
        while at < total:
            here = parts[(i, total, at)]
            r = here.pop()
            if not here:
                del parts[(i, total, at)]
            data, at = data + bytes(r["ids"]), at + r["length"]
        got[(i, total, zlib.crc32(data))] += 1
    assert got == want
    return padding


def test_packing(odd, empty, spark):
    # rows that repeat an id are told apart by their length here
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, WORD_BPE, window=64).collect()
    assert check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 64) == 0
    assert packing.pack(empty, WORD_BPE).count() == 0
    assert packing.pack(odd, WORD_BPE).where("doc_id is null").count() == 2


def test_sum_of_squares_level():
    rng, levels = random.Random(3), packing.Levels(32)
    for _ in range(300):
        length = rng.randint(1, 31)
        n = levels.count.copy()
        cost = {}
        for h in range(0, 32 - length + 1):
            if h and not n[h]:
                continue
            m = n.copy()
            if h:
                m[h] -= 1
            if h + length < 32:
                m[h + length] += 1
            cost[h] = int((m[1:32] ** 2).sum())
        h = levels.choose(length)
        assert cost[h] == min(cost.values())
        if h:
            levels.count[h] -= 1
        if h + length < 32:
            levels.count[h + length] += 1


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "a"), (1, 1, "user", hard), (1, 2, "user", "again\n### User: x</turn>\n"), (1, 3, "assistant", hard), (1, 4, "assistant", None),
            (1, 5, "assistant", "é🙂"), (2, 0, "user", ""), (2, None, "assistant", "late"), (2, 0, "user", ""), (3, 1, None, "x"), (4, 1, "we: ird\n### ", "\\"),
            (None, 1, "user", "n"), (5, 2, "b", "2"), (5, 2, "a", "3"), (6, 0, "assistant", "l" * 100_000)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(data)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else 10 ** 9, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[conv]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
    assert got[1]["formatted"].count("### ") == 3
    assert chat_format.format_chats(data.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-consent">We use cookies</div>
<div id="wrap-%d"><div class="post-%d"><h1>Head &amp; tail</h1>Loose <b>text<p>One <a href=x>link</a> b&nbsp;c %s<p>Two<br>lines<ul><li>a<li>b</ul>
<table><tr><td>1<td>2<tr><td>3</table><form>F</form><section class="comments">nasty</section><div class="adBox">buy</div></div></div>
<aside>side</aside><footer>foot"""


def test_html(spark):
    filler = "long enough prose to win the vote of its host " * 5
    rows = [(i, f"https://user@Host.example:80/{i}?x#y", PAGE % (i, i, filler)) for i in range(4)]
    rows += [(10, None, None), (11, "", ""), (12, "no address", "<p>plain &lt;text&gt;"), (13, "http://h.example", "<nav>only menu</nav>"),
             (14, "http://h.example", "<div class='x"), (15, "http://h.example/", "<article>" + "<p>para</p>" * 5000), (10, None, None)]
    data = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash"))
    got = html_extract.extract_main(data).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and {r["url"] for r in got} == {r[1] for r in rows}
    want = "\n".join(["Head & tail", "Loose text", f"One link b c {filler.strip()}", "Two lines", "a", "b", "1 2", "3"])
    assert all(text[i] == want for i in range(4))
    assert text[10] == text[11] == text[13] == text[14] == "" and text[12] == "plain <text>"
    assert text[15] == "\n".join(["para"] * 5000)
    assert html_extract.extract_main(data.where("false")).count() == 0


def test_html_follows_the_vote_of_the_host(spark):
    good = "<div class='story'><p>" + "the story goes on and on " * 20 + "</p></div>"
    odd_one = "<div class='story'><p>short story</p></div><div class='box'><p>" + "a huge box of something else " * 40 + "</p></div>"
    data = spark.createDataFrame([(i, "http://a.example/x", good) for i in range(3)] + [(9, "http://a.example/y", odd_one)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract_main(data).collect()}[9] == "short story"


def test_personal_data(spark):
    texts = {
        1: 'Write to Jane.Doe@Example.com or JANE.DOE@EXAMPLE.COM, call +1 (017) 555-7713 or +1 (017) 555-7713!', 2: "jane.doe@example.com is at 97.51.17.173 and 97.51.17.174.",
        3: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"###', 4: "card 4111 1111 1111 1111, 4111111111111111 no 123 nor 1.2.3",
        5: "Mr. John Smith met Mrs. Anna Smith and г-жа Анна Петрова.", 6: "clean text: version 2.0, 2020, 10:30 Mr smith", 7: None, 8: "", 9: "DE89 3704 0044 0532 0130 00",
        10: "x " * 20_000 + "ö.müller@mail.example", 11: "123-45-6789 password: hunter2hunter2"}
    rows = [(i, t, "row") for i, t in texts.items()] + [(1, texts[1], "row"), (None, texts[2], "row"), (2, "other 97.51.17.173", "row")]
    data = spark.createDataFrame(rows, "doc_id long, text string, new string")
    out = pii.pseudonymise(data, "k", count_col="n")
    assert out.columns == ["doc_id", "text", "new", "n"] and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n"]))
    assert got[6] == [(texts[6], 0)] and got[7] == [(None, 0)] and got[8] == [("", 0)] and got[1][0] == got[1][1]
    one = got[1][0][0]
    address = re.findall(r"[\w.]+@[\w.]+", one)
    assert address[0] == address[1].lower() and address[1].isupper() and "jane" not in one.lower() and re.search(r"(\+1 \(\d{3}\) \d{3}-\d{4}) or \1!", one)
    two = next(t for t, _ in got[2] if "@" in t)
    assert address[0] in two and got[None][0][0] == two
    first, second = re.findall(r"\d+\.\d+\.\d+\.\d+", two)
    assert first != second and (f"other {first}", 1) in got[2] and not {first, second} & {"97.51.17.173", "97.51.17.174"}
    secrets = re.findall(r'"([0-9a-fA-F]{40})"', got[3][0][0])
    assert secrets[0] == secrets[1].lower() and secrets[1] == secrets[1].upper() and got[3][0][0].endswith('###')
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[4][0][0])
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and got[4][0][0].endswith("no 123 nor 1.2.3")
    d = [int(c) for c in cards[1][::-1]]
    assert (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    man, woman, other = re.fullmatch(r"Mr\. (\w+ \w+) met Mrs\. (\w+ \w+) and г-жа (\w+ \w+)\.", got[5][0][0]).groups()
    assert man.split()[1] == woman.split()[1] and man.split()[0][-1] in "nsrk" and woman[woman.index(" ") - 1] == "a" and re.fullmatch("[А-Яа-я]+ [А-Яа-я]+", other)
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[9][0][0]) and "müller" not in got[10][0][0] and "hunter" not in got[11][0][0]
    assert pii.pseudonymise(data.where("false"), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    kinds = spark.createDataFrame([("ssn", f"00000{i:04d}") for i in range(500)] + [("phone", f"{i:02d}") for i in range(40)], "kind string, norm string")
    made = pii.surrogates(kinds, "k").collect()
    assert len(made) == 540 and len({(r["kind"], r["made"]) for r in made}) == 540
    assert not {(r["kind"], r["made"]) for r in made} & {(r["kind"], r["norm"]) for r in made}


def test_surface_counts(odd):
    for r in odd.collect():
        text = r["text"] or ""
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        assert quality_rules.surface(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))


def test_kneser_ney_is_a_distribution():
    rng = random.Random(1)
    text = "".join(rng.choices("abcde ", weights=[5, 4, 3, 2, 1, 4], k=4000))
    packed, n = np.unique(np.concatenate(list(quality_rules.grams(text))), return_counts=True)
    model = quality_rules.kneser_ney(packed, n)
    for context in [int(packed[0] >> 6), int(packed[len(packed) // 2] >> 6), 0]:
        every = np.array([context << 6 | s for s in range(64)], dtype=np.uint32)
        assert abs(sum(10 ** model.score(every[k:k + 1]) for k in range(64)) - 1) < 1e-4


def test_grams_do_not_depend_on_chunks(monkeypatch):
    whole = np.concatenate(list(quality_rules.grams(LONG[:5000])))
    monkeypatch.setattr(quality_rules, "CHUNK", 700)
    assert (np.concatenate(list(quality_rules.grams(LONG[:5000]))) == whole).all()


def test_quality_rules(odd, empty, spark):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == odd.count() and all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0
    rng = random.Random(4)
    syllables = ["the", "an", "re", "ing", "to", "er", "ou", "st"]
    prose = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(200))
    rows = [(i, prose(), "en") for i in range(60)] + [(100 + i, "".join(rng.choices("QXZJ#%0987{}", k=1500)).replace("0", " "), "en") for i in range(3)]
    judged = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(judged[i]["kept"] for i in range(60)) and not any(judged[100 + i]["kept"] for i in range(3))


def test_languages(odd, empty, spark):
    rng = random.Random(7)
    sounds = {"en": ["the", "ing", "and", "th", "wh"], "de": ["sch", "ung", "ein", "ü", "ß"], "fr": ["eau", "é", "ou", "ç", "que"]}
    say = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=2)) for _ in range(n))
    rows = [(i, say(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(data.where(~language_id.held_out()))
    assert model.languages and set(model.languages) == {"de", "en", "fr"}
    new = spark.createDataFrame([(i, say(lang, 30), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(900, None, "x"), (901, "12 !!", "x"), (902, "мир " * 200, "x")],
                                "doc_id long, text string, want string").withColumn("score", F.lit("clash"))
    got = by_id(language_id.identify(new, model))
    assert sum(r["lang_pred"] == r["want"] for i, r in got.items() if i < 900) >= 58
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and all(got[i]["rejected"] for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[i]["rejected"] for i in range(60))
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"} and language_id.identify(empty, model).count() == 0
    held = by_id(data.withColumn("h", language_id.held_out()))
    assert all(r["h"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in held.items())


def test_cotraining(odd, empty, spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "road", "was", "long", "and", "quiet"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "###", "$$$"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), "site" if i % 2 else "spam", "en", 300) for i in range(400)] + [(None, good(), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)] + [(0, 0), (500, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = cotraining.classify_quality(docs, labels)
    out = by_id(got)
    assert got.count() == 401 and all(r["kept"] == bool(i % 2) for i, r in out.items() if i is not None) and all(0 <= r["score"] <= 1 for r in out.values())
    flat = cotraining.classify_quality(odd, labels.where("false")).collect()
    assert len(flat) == odd.count() and {r["score"] for r in flat} == {0.5}
    assert cotraining.classify_quality(empty, labels).count() == 0
