"""Quality rules: surface counts and bands of n-gram perplexity by language.

Spark counts the words of all texts, whole and unfolded, and the character n-grams.  A word's probability is its discounted
count without the occurrence in question, mixed with the probability of its spelling.  The table of words grows with the corpus:
the most frequent ones, 2^20 at most, go to every task, and the others are joined by their hash.

The spelling comes from a modified Kneser-Ney model over characters whose n-grams are kept as sorted hash arrays: the hash
of an n-gram is its symbols' codes packed side by side, so it cannot collide.  There are 64 symbols and four places, hence at
most 2^24 entries of eight bytes; only words that the corpus hardly has elsewhere rest on it alone.
Texts whose perplexity leaves the band of their language and length, above or below, are rejected; the bands come from
the quartiles of the corpus itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared, store, text_of

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
MARKS = "#*$%&|<>"
WIDTH = 7.0  # a limit lies so many times the distance of its quartile from the median: about 4.7 standard deviations of a normal spread
LEAST = 0.05  # but never nearer to the median than this, in log10: texts that hardly differ make no narrower band
STEADY = 30.0  # a length class with so many different texts counts as much for its band as its whole language
CHUNK = 1 << 20
FREQUENT = 1 << 20  # words whose counts every task holds; the counts of all others reach the texts through a join
REMEMBERED = 400_000  # different words that a task keeps in memory at a time
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that continue a code point in UTF-8


def symbol_table() -> np.ndarray:
    """Code of each code point of the first plane: 0 other white space, 1 space, small and capital letters, digit,
    stops, marks of markup, other signs, and the other letters in classes by code point."""
    table = np.zeros(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c == " ":
            code = 1
        elif c.isspace() or i < 32:
            code = 0
        elif "a" <= c <= "z":
            code = 2 + ord(c) - ord("a")
        elif "A" <= c <= "Z":
            code = 28 + ord(c) - ord("A")
        elif c.isalpha():
            code = 58 + i % 6
        else:
            code = 54 if c.isdigit() else 55 if c in ".,;:" else 56 if c in MARKS else 57
        table[i] = code
    return table


_TABLES: dict[str, np.ndarray] = {}


def pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of a text and the packed n-gram that ends at each; three blanks stand before the first."""
    if "symbols" not in _TABLES:
        _TABLES["symbols"] = symbol_table()
    table, tail = _TABLES["symbols"], np.ones(ORDER - 1, dtype=np.uint32)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.concatenate((tail, table[points & np.uint32(0xFFFF)]))
        packed = codes[:-3] << np.uint32(18) | codes[1:-2] << np.uint32(12) | codes[2:-1] << np.uint32(6) | codes[3:]
        tail = codes[-(ORDER - 1):]
        yield points, packed


def grams(text: str) -> Iterator[np.ndarray]:
    """Packed n-grams of a text, one for each code point."""
    return (packed for _, packed in pieces(text))


def letter_runs(packed: np.ndarray) -> int:
    """Number of runs of letters, the words over which perplexity is taken: signs between them add to it, not to their number."""
    last, before = packed & np.uint32(SYMBOLS - 1), packed >> np.uint32(BITS) & np.uint32(SYMBOLS - 1)
    letter = lambda code: (code >= 2) & (code < 54) | (code >= 58)
    return int((letter(last) & ~letter(before)).sum())


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: counts over all texts; each task adds up its own before the shuffle."""
    prepared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS * ORDER, dtype=np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal waiting, size
            if waiting:
                found, n = np.unique(np.concatenate(waiting), return_counts=True)
                total[found] += n
            waiting, size = [], 0

        for b in batches:
            for t in b.column(0):
                for g in grams(t.as_py()):
                    waiting.append(g)
                    size += len(g)
                    if size > 2_000_000:
                        add()
        add()
        at = np.nonzero(total)[0]
        for k in range(0, len(at), 50_000):
            some = at[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    return docs.select(text_of(text_col)).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class PerplexityModel:
    """log10 probabilities of the seen n-grams of the highest order, sorted by hash, and of all shorter endings."""

    keys: np.ndarray  # sorted packed n-grams
    logs: np.ndarray
    backoff: np.ndarray  # log10 weight left for unseen continuations, by context of three symbols
    lower: np.ndarray  # log10 probability by the last three symbols

    def each(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram."""
        if not len(self.keys):
            return np.full(len(packed), -np.log10(SYMBOLS))
        at = np.minimum(np.searchsorted(self.keys, packed), len(self.keys) - 1)
        logs = self.logs[at]
        unseen = np.nonzero(self.keys[at] != packed)[0]
        if len(unseen):
            other = packed[unseen]
            logs[unseen] = self.backoff[other >> np.uint32(BITS)] + self.lower[other & np.uint32(SYMBOLS ** 3 - 1)]
        return logs

    def table(self) -> np.ndarray:
        """``each`` of all 2^24 n-grams, 64 MB."""
        if not len(self.keys):
            return np.full(SYMBOLS ** ORDER, -np.log10(SYMBOLS), dtype=np.float32)
        out = np.empty((SYMBOLS, SYMBOLS ** 2, SYMBOLS), dtype=np.float32)
        np.add(self.backoff.reshape(SYMBOLS, -1, 1), self.lower.reshape(1, -1, SYMBOLS), out=out)
        out = out.reshape(-1)
        out[self.keys] = self.logs
        return out

    def score(self, packed: np.ndarray) -> float:
        """Sum of log10 probabilities."""
        return float(self.each(packed).sum(dtype=np.float64))


def discounts(n: list[int]) -> np.ndarray:
    """The three discounts of the modified method from the numbers of n-grams met once to four times; 0 for count zero."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
        out.append(min(max(d, 0.1 * k), 0.95 * k))
    return np.array(out)


def kneser_ney(grams_: np.ndarray, n: np.ndarray) -> PerplexityModel:
    """Interpolated modified Kneser-Ney of order four: the highest order by counts, lower ones by distinct left neighbours."""
    order = np.argsort(grams_, kind="stable")
    keys, counts = grams_[order].astype(np.uint32), n[order].astype(np.float64)
    below = np.full(SYMBOLS, 1.0 / SYMBOLS)  # order zero: all symbols alike
    level = [(keys, counts)]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols seen before each shorter n-gram
        found, left = np.unique(level[0][0] & np.uint32(SYMBOLS ** k - 1), return_counts=True)
        level.insert(0, (found, left.astype(np.float64)))
    weights = probabilities = None
    for k, (some, c) in enumerate(level, start=1):
        context = (some >> np.uint32(BITS)).astype(np.int64)
        d = discounts([int((c == k).sum()) for k in range(1, 5)])[np.minimum(c, 3).astype(int)]
        size = SYMBOLS ** (k - 1)
        total = np.bincount(context, weights=c, minlength=size)
        left = np.bincount(context, weights=d, minlength=size)
        weights = np.where(total > 0, left / np.maximum(total, 1e-300), 1.0)
        if k < ORDER:  # a full table: every continuation of every context
            full = weights[:, None] * below.reshape(-1, SYMBOLS)[np.arange(size) % max(1, size // SYMBOLS)] if k > 1 else weights[:, None] * below[None, :]
            full = full.reshape(-1)
            full[some] += (c - d) / total[context]
            below = full
        else:
            probabilities = (c - d) / total[context] + weights[context] * below[some & np.uint32(SYMBOLS ** 3 - 1)]
    return PerplexityModel(keys, np.log10(probabilities).astype(np.float32), np.log10(np.maximum(weights, 1e-12)).astype(np.float32),
                           np.log10(below).astype(np.float32))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """64 bits of BLAKE2b of each word: two of a hundred million words share a hash in one corpus of some 3,700."""
    return np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in words), dtype="<i8")


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (hash), n: counts over all texts; each task adds up its own before the shuffle."""
    prepared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words, n = list(found), np.fromiter(found.values(), dtype=np.int64, count=len(found))
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words[k:k + 50_000])), pa.array(n[k:k + 50_000])], names=["word", "n"])
            found.clear()

        for b in batches:
            for t in b.column(0):
                found.update(t.as_py().encode("utf-8", "surrogatepass").split())
                if len(found) > REMEMBERED:
                    yield from told()
        yield from told()

    return docs.select(text_of(text_col)).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class WordShares:
    """What a word's probability takes from its count and what it leaves to its spelling.

    The occurrence that is judged is taken out of the counts first: a word met once is new to the rest of the corpus.
    """

    total: int  # words of the corpus
    taken: np.ndarray  # discounts of the counts 0, 1, 2 and more
    left: float  # sum of the discounts of all different words

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share by the count and weight of the spelling for words met n times, 0 for words that were not counted."""
        other = np.maximum(n - 1, 0)
        if self.total < 2:
            return np.zeros(len(n)), np.ones(len(n))
        now, then = self.taken[np.minimum(other, 3)], self.taken[np.minimum(n, 3)]
        return (other - now) / (self.total - 1), (self.left - then + now) / (self.total - 1)

    def logs(self, n: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """log10 probabilities of words met n times, with the log10 probability of the spelling of each."""
        known, weight = self.of(n)
        # A word that is nowhere else rests on its spelling alone, whose probability may be too small to write out.
        return np.log10(np.where(known > 0, known + weight * np.power(10.0, spelling), weight)) + np.where(known > 0, 0.0, spelling)

    def column(self, n: Column, spelling: Column) -> Column:
        """``logs`` as a column; there are two words at least."""
        other = F.greatest(n - 1, F.lit(0))
        taken = F.array(*[F.lit(float(d)) for d in self.taken])
        now, then = (taken[F.least(c, F.lit(3)).cast("int")] for c in (other, n))
        known, weight = (other - now) / (self.total - 1), (F.lit(self.left) - then + now) / (self.total - 1)
        return F.when(known > 0, F.log10(known + weight * F.pow(F.lit(10.0), spelling))).otherwise(F.log10(weight) + spelling)


@dataclass
class CorpusModel:
    """Spelling, the counts of all words as a stored table, and those of the frequent words as sorted hash arrays."""

    spelling: PerplexityModel
    shares: WordShares
    words: DataFrame  # word, n
    least: int  # all words met at least so often are frequent
    keys: np.ndarray
    counts: np.ndarray


def fit_perplexity(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> CorpusModel:
    """The model of all texts.

    The driver gets a row for each distinct n-gram of characters, at most 2^24, for each distinct count of a word, which are
    fewer than the root of twice the number of words, and for each of at most ``frequent`` words.
    """
    counted = count_grams(docs, text_col).toArrow()
    spelling = (kneser_ney(counted["gram"].to_numpy(), counted["n"].to_numpy()) if counted.num_rows
                else PerplexityModel(np.zeros(0, np.uint32), *[np.zeros(0, np.float32)] * 3))
    words = store(count_words(docs, text_col), "words")
    times = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toArrow()
    n, many = (times[c].to_numpy().astype(np.int64) for c in ("n", "words"))
    taken = discounts([int(many[n == k].sum()) for k in range(1, 5)])
    within = np.cumsum(many) <= frequent
    least = 1 if within.all() else int(n[within][-1]) if within.any() else int(n[0]) + 1
    top = words.where(F.col("n") >= least).toArrow()
    order = np.argsort(top["word"].to_numpy(), kind="stable")
    shares = WordShares(int((n * many).sum()), taken, float((taken[np.minimum(n, 3)] * many).sum()))
    return CorpusModel(spelling, shares, words, least, top["word"].to_numpy()[order], top["n"].to_numpy()[order])


def surface(text: str, parts: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, whose words may be given."""
    parts = text.encode("utf-8", "surrogatepass").split() if parts is None else parts
    n = len(parts)
    joined = b"".join(parts)
    chars = len(joined.translate(None, FOLLOWING))
    signs = sum(map(text.count, MARKS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    repeated = 0
    if n > 5 and len(set(parts)) < n:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(p, len(number)) for p in parts), dtype=np.int64, count=n)
        m = n - 4
        # Windows become numbers two words at a time: equal numbers stand for equal windows.
        code = ids
        for step, width in ((1, 2), (2, 4)):
            _, code = np.unique(code[:-step] * (int(code.max()) + 1) + code[step:], return_inverse=True)
        _, code, times = np.unique(code[:m] * (int(ids.max()) + 1) + ids[4:], return_inverse=True, return_counts=True)
        start = np.zeros(n + 1, dtype=np.int64)
        hit = times[code] > 1
        np.add.at(start, np.nonzero(hit)[0], 1)
        np.add.at(start, np.nonzero(hit)[0] + 5, -1)
        repeated = int((np.cumsum(start[:-1]) > 0).sum())
    return n, chars, signs, again, repeated


def spelled(text: str, table: np.ndarray) -> tuple[np.ndarray, float, int]:
    """log10 probability of the spelling of each word, up to and with the white space that ends it, that of the rest, and the runs of letters."""
    logs, white, runs = [np.zeros(1)], [], 0
    for points, packed in pieces(text):
        logs.append(table[packed])
        white.append((points == 32) | (points - np.uint32(9) < 5))
        runs += letter_runs(packed)
    sums = np.cumsum(np.concatenate(logs), dtype=np.float64)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], *white, [True]))))
    each = sums[np.minimum(edges[1::2] + 1, len(sums) - 1)] - sums[edges[::2]]
    return each, float(sums[-1] - each.sum()), runs


def rated(docs: DataFrame, model: CorpusModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the surface counts, n_runs (of letters) and log10 of the perplexity of one (null where there is none).

    The texts are those of which the model was made.  Where not all words are frequent, a text's other words are joined
    with their counts and their logarithms added to it.
    """
    prepared(docs)
    # 2^24 entries and 2^20 words at most
    shipped = docs.sparkSession.sparkContext.broadcast((model.spelling.keys, model.spelling.logs, model.spelling.backoff, model.spelling.lower, model.keys, model.counts))
    shares, some_rare = model.shares, model.least > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *arrays, keys, counts = shipped.value
        table = PerplexityModel(*arrays).table()
        known: dict[bytes, int] = {}  # -1 for words whose counts the task does not have
        row = TaskContext.get().partitionId() << 33

        def learn(words: list[bytes]) -> None:
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set(words).difference(known))
            n = np.full(len(new), -1 if some_rare else 0, dtype=np.int64)
            if len(keys):
                hashes = word_hashes(new)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                n = np.where(keys[at] == hashes, counts[at], n)
            known.update(zip(new, n.tolist()))

        for b in batches:
            rows = []
            for t in b.column(2):
                text = t.as_py()
                words = text.encode("utf-8", "surrogatepass").split()
                learn(words)
                each, total, runs = spelled(text, table)
                n = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                rare = np.flatnonzero(n < 0)
                total += float(shares.logs(n[n >= 0], each[n >= 0]).sum())
                rows.append((*surface(text, words), runs, -total if runs else None, row,
                             word_hashes(words[k] for k in rare).tolist() if runs else [], each[rare].tolist() if runs else []))
                row += 1
            columns = list(zip(*rows)) or [[]] * 10
            kinds = [*[pa.int64()] * 6, pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_runs", "minus", "_row", "_words", "_logs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col)).mapInArrow(
        run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_runs long, "
             "minus double, _row long, _words array<long>, _logs array<double>")
    if some_rare:
        rows = store(rows, "surface")
        rare = rows.select("_row", F.inline(F.arrays_zip(F.col("_words").alias("word"), F.col("_logs").alias("spelling"))))
        # Whole numbers of 10^-9, so that the order in which tasks end changes no sum.
        log = F.round(shares.column(F.coalesce("n", F.lit(0)), F.col("spelling")) * 1e9).cast("long")
        more = rare.join(model.words.where(F.col("n") < model.least), "word", "left").groupBy("_row").agg(F.sum(log).alias("more"))
        rows = rows.join(more, "_row", "left").withColumn("minus", F.col("minus") - F.coalesce("more", F.lit(0)) / 1e9)
    return rows.withColumn("log_ppl", F.col("minus") / F.col("n_runs")).drop("minus", "_row", "_words", "_logs")


def perplexity_bands(rows: DataFrame, width: float = WIDTH, steady: float = STEADY) -> DataFrame:
    """lang_key, length_class, low, high: limits of log10 perplexity from texts that pass the base rule.

    ``rows`` has lang_key, length_class (the power of two below the runs), n_runs, log_ppl and base_failed.  Median and quartiles
    of a class are mixed with those of its language, by the number of texts in the class against ``steady``; each side has its own
    width.  This is done with every copy and with each text once, and the outer limits hold: a large group of copies can
    neither narrow a band nor fall out of it.
    """
    passed = rows.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select("lang_key", "length_class", "n_runs", "log_ppl")
    quartiles = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000)

    def limits(texts: DataFrame) -> DataFrame:
        single = texts.groupBy("lang_key", "length_class").agg(F.count(F.lit(1)).alias("n"), quartiles.alias("own"))
        common = texts.groupBy("lang_key").agg(quartiles.alias("all"))
        share = F.col("n") / (F.col("n") + steady)
        at = lambda k: share * F.col("own")[k] + (1 - share) * F.col("all")[k]
        both = single.join(common, "lang_key").select("lang_key", "length_class", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
        side = lambda d: F.greatest(width * d, F.lit(LEAST))
        return both.select("lang_key", "length_class", (F.col("b") - side(F.col("b") - F.col("a"))).alias("low"), (F.col("b") + side(F.col("c") - F.col("b"))).alias("high"))

    return limits(passed).union(limits(passed.distinct())).groupBy("lang_key", "length_class").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  width: float = WIDTH, steady: float = STEADY) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ppl, kept.

    Words are runs without ASCII white space; null text counts as empty and fails the base rule.  Texts are read whole, in
    pieces, whatever their length.  The bands are those of ``perplexity_bands``; a null language is a language of its own, and a text
    without letters has no perplexity and is not kept.
    Repeated rows each count; an empty table gives no rows; other columns are ignored.
    """
    rows = store(rated(docs, fit_perplexity(docs, text_col), id_col, text_col, lang_col), "rated")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "lang_key": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")),
                             "length_class": F.coalesce(F.floor(F.log2("n_runs")), F.lit(-1)).cast("int")})
    # Stored, so that Spark sees their size and sends them to the rows instead of sorting all rows by language.
    judged = rows.join(store(perplexity_bands(rows, width, steady), "bands"), ["lang_key", "length_class"], "left")
    return judged.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "log_ppl", F.coalesce(~F.col("base_failed") & F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False)).alias("kept"))
