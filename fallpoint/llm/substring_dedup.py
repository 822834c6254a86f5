"""Repeated passages by seed and extend.

Seeds are winnowed word n-grams: of all windows of ``window`` words each chooses its least
n-gram, so equal windows choose alike and neighbouring windows mostly share one seed.  The
windows of one seed that follow one another are a run; its span is the seed extended to both
sides as far as the seed is the choice.  Occurrences meet by seed; those whose seed occurs nowhere
else go no further.  Of the others,

* spans that are equal as a whole are repeated as a whole, told by one count per distinct span;
* where spans of one seed differ, each distinct span sends one of its occurrences, and its windows
  tell how far to either side it matches any other.

So a group of copies costs one row per span however large it is, and no pairs are formed.  Runs
that touch make maximal repeats.  Windows are compared by 128-bit hashes of their words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared, shared_folder, store, text_of

WINDOW = 35         # words of a window
SEED_WORDS = 8      # words of a seed
PIECE = 1 << 20     # bytes that a task works on at a time; longer texts go through in pieces that overlap by a window

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = tuple(np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def pieces(text: bytes, overlap: int, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, bytes) of parts of a text cut between words; each but the first repeats ``overlap`` words."""
    at = word = 0
    while at < len(text):
        end = min(at + size, len(text))
        while True:
            while end < len(text) and not _SPACE[text[end]]:  # to the end of the word
                end += 1
            part = text[at:end]
            if end == len(text):
                yield word, part
                return
            inside = ~_SPACE[np.frombuffer(part, np.uint8)]
            starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
            if len(starts) > overlap:
                break
            end = min(end + size, len(text))
        yield word, part
        word += len(starts) - overlap
        at += int(starts[len(starts) - overlap]) if overlap else len(part)


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, grown when needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            one = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))))
            self.up, self.down = one(self.base), one(inverse)
        return self.up[:n], self.down[:n]


_TABLES: list[_Powers] = []


def _tables() -> list[_Powers]:
    if not _TABLES:
        _TABLES.extend(_Powers(b) for b in _ODD)
    return _TABLES


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several parts of texts laid end to end, with two independent running sums that give the hash of any stretch."""

    def __init__(self, parts: list[bytes]):
        buffer = np.frombuffer(b"\n".join(parts), np.uint8)
        tables = _tables()
        inside = np.concatenate(([False], ~_SPACE[buffer], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        ends_of_parts = np.cumsum([len(p) + 1 for p in parts])
        self.part = np.searchsorted(ends_of_parts, start, side="right")
        up, down = tables[0].get(len(buffer) + 1)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:len(buffer)])))
        word = (run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[1]
        self.sums = []
        for k, table in enumerate(tables[1:]):
            up, _ = table.get(len(word) + 1)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(word + _ODD[k]) * up[:len(word)]))))
        self.count = len(word)

    def hashes(self, first: np.ndarray, words, which: int) -> np.ndarray:
        """Hash of ``words`` words from each place on."""
        run, (_, down) = self.sums[which], _tables()[which + 1].get(self.count + 1)
        return _mixed((run[first + words] - run[first]) * down[first] + np.asarray(words, dtype=np.uint64))


def runs_of(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, seed's hash, two hashes of the span) of every run of windows with one seed."""
    n = words.count - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    grams = words.hashes(np.arange(words.count - seed + 1), seed, 0)
    # The first least n-gram of each window, by doubling.
    width, reach = window - seed + 1, 1
    best, place = grams.copy(), np.arange(len(grams))
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        take = right < left
        best, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        reach += step
    starts = np.flatnonzero(words.part[:n] == words.part[window - 1:])
    place = place[:n][starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, many = starts[at], np.diff(np.append(at, len(starts)))
    return first, many, grams[place[at]], words.hashes(first, many + window - 1, 0), words.hashes(first, many + window - 1, 1)


def _groups(batch: pa.RecordBatch, overlap: int) -> Iterator[tuple[list[bytes], list[int], np.ndarray]]:
    """Parts of the texts (last column) in lots of about PIECE bytes: (parts, rows, number of each part's first word)."""
    parts, rows, firsts, size = [], [], [], 0
    for i, text in enumerate(batch.column(batch.num_columns - 1)):
        text = text.as_py()
        if len(text) > PIECE and size:
            yield parts, rows, np.array(firsts)
            parts, rows, firsts, size = [], [], [], 0
        for first, part in pieces(text, overlap):
            parts.append(part)
            rows.append(i)
            firsts.append(first)
            size += len(part)
            if size >= PIECE:
                yield parts, rows, np.array(firsts)
                parts, rows, firsts, size = [], [], [], 0
    if parts:
        yield parts, rows, np.array(firsts)


def _word_numbers(words: Words, firsts: np.ndarray) -> np.ndarray:
    """Number of each word in its own text."""
    begin = np.searchsorted(words.part, np.arange(len(firsts)))
    return np.arange(words.count) - begin[words.part] + firsts[words.part]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _occurrences(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(row, lo, n, seed, r1, r2) of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for parts, at, firsts in _groups(b, window - 1):
                words = Words(parts)
                first, many, gram, r1, r2 = runs_of(words, window, seed)
                if len(first):
                    yield pa.record_batch([pa.array(ids[np.array(at)[words.part[first]]]), pa.array(_word_numbers(words, firsts)[first].astype(np.int32)),
                                           pa.array(many.astype(np.int32)), _signed(gram), _signed(r1), _signed(r2)],
                                          names=["row", "lo", "n", "seed", "r1", "r2"])

    return rows.select("row", "content").mapInArrow(run, "row long, lo int, n int, seed long, r1 long, r2 long")


def _windows(spans: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """(w1, w2, r1, r2, k, times): the windows of one occurrence of each span."""
    wanted = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "n", "r1", "r2", "times")).alias("spans"))
    data = wanted.join(rows.select("row", "content"), "row").select("spans", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), sizes)
            lo, n, r1, r2, times = (flat.field(c).to_numpy() for c in ("lo", "n", "r1", "r2", "times"))
            for parts, at, firsts in _groups(b, window - 1):
                words = Words(parts)
                at, begin = np.array(at), np.searchsorted(words.part, np.arange(len(parts) + 1))
                for j in range(len(parts)):
                    mine = np.flatnonzero((owner == at[j])) if len(lists) < 50 else np.arange(*np.searchsorted(owner, [at[j], at[j] + 1]))
                    # Windows of this part; the next part repeats the last words, not the windows.
                    here = begin[j + 1] - begin[j] - window + 1
                    if not len(mine) or here <= 0:
                        continue
                    first = np.repeat(lo[mine], n[mine]) + np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
                    k = first - np.repeat(lo[mine], n[mine])
                    which = np.repeat(mine, n[mine])
                    ok = (first >= firsts[j]) & (first < firsts[j] + here)
                    place, k, which = first[ok] - firsts[j] + begin[j], k[ok], which[ok]
                    if len(place):
                        yield pa.record_batch([_signed(words.hashes(place, window, 0)), _signed(words.hashes(place, window, 1)), pa.array(r1[which]),
                                               pa.array(r2[which]), pa.array(k.astype(np.int32)), pa.array(times[which])],
                                              names=["w1", "w2", "r1", "r2", "k", "times"])

    return data.mapInArrow(run, "w1 long, w2 long, r1 long, r2 long, k int, times long")


def _bucketed(rows: DataFrame) -> DataFrame:
    """The rows stored once in buckets of ``row``: both later joins find the texts in place, without a shuffle of theirs."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"passages_{uuid.uuid4().hex}"
    (rows.repartition(parts, "row").write.format("parquet").bucketBy(parts, "row").sortBy("row")
     .option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def repeated_runs(rows: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """(row, lo, mask): windows from word ``lo`` on whose words also start elsewhere, bit k for window lo + k.

    ``rows`` (row, content): row numbers, each once, and texts in bytes.
    """
    if not 1 <= seed <= window or window - seed > 62:
        raise ValueError("a seed has at most as many words as a window and at most 62 less")
    # A seed that occurs once starts no match: told before anything else about a run travels.
    every = _occurrences(rows, window, seed)
    # Small sides of the joins are stored: a join that reads both sides from shuffles can be split where a key is very common.
    often = store(every.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("seed"), "seeds")
    found = store(every.join(often, "seed", "left_semi"), "runs")
    spans = store(found.groupBy("seed", "r1", "r2").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"),
                                                        F.min(F.struct("row", "lo")).alias("at")), "spans")
    mixed = store(spans.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("seed"), "mixed-seeds")
    one = spans.join(mixed, "seed", "left_semi").select("at.row", "at.lo", "n", "r1", "r2", "times")
    windows = store(_windows(one, rows, window), "windows")
    again = store(windows.groupBy("w1", "w2").agg(F.sum("times").alias("all")).where("all > 1").select("w1", "w2"), "repeated-windows")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    partly = windows.join(again, ["w1", "w2"], "left_semi").groupBy("r1", "r2").agg(F.bit_or(bit).alias("mask"))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    whole = spans.where("times > 1").select("r1", "r2", full.alias("mask"))
    # A span that occurs twice is repeated as a whole; its windows say nothing new.
    masks = store(whole.union(partly).groupBy("r1", "r2").agg(F.bit_or("mask").alias("mask")), "masks")
    return found.select("row", "lo", "r1", "r2").join(masks, ["r1", "r2"]).select("row", "lo", "mask")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    seed: int = SEED_WORDS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (words left, one space between), repeats array<struct<start, words>>.

    Words are runs of characters other than ASCII white space, compared unchanged.  Every word that lies in a window of
    ``window`` words whose sequence also starts anywhere else, in the same text too, is removed; windows are judged on the
    input.  ``repeats`` are the maximal stretches removed, in words.  A null or empty text has no words; texts
    shorter than a window lose none; of repeated rows each is the other's copy, null ids too.  Texts of any length go through
    in pieces; a row of the result holds what is left of its text.  An empty table gives no rows; other columns are ignored.
    """
    prepared(docs)
    rows = _bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                                 text_of(F.col(f"`{text_col}`")).cast("binary").alias("content")))
    id_type = rows.schema["id"].dataType.simpleString()
    lists = repeated_runs(rows, window, seed).groupBy("row").agg(F.collect_list(F.struct("lo", "mask")).alias("found"))
    data = rows.join(lists, "row", "left").select("id", "found", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "n_removed", "kept", "repeats"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
        for b in batches:
            out, size, since = [], 0, 0
            for i, (found, content) in enumerate(zip(b.column(1), b.column(2))):
                n, removed, kept, spans = cleaned(content.as_py(), found.values if found.is_valid else None, window)
                out.append((n, removed, kept, spans))
                size += len(kept)
                if size > PIECE or i + 1 == b.num_rows:
                    yield pa.record_batch([b.column(0).slice(since, len(out)), pa.array([o[0] for o in out], pa.int64()),
                                           pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()),
                                           pa.array([o[3] for o in out], kind)], names=names)
                    out, size, since = [], 0, i + 1

    schema = f"id {id_type}, n_words long, n_removed long, kept binary, repeats array<struct<start: long, words: long>>"
    return data.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "repeats")


def cleaned(text: bytes, found: pa.Array | None, window: int) -> tuple[int, int, bytes, list[dict]]:
    """(words, words removed, text left, stretches removed) of one text with its runs (lo, mask)."""
    if found is None or not len(found):
        lots = [part.split() for _, part in pieces(text, 0)]
        return sum(map(len, lots)), 0, b" ".join(b" ".join(lot) for lot in lots if lot), []
    lo, mask = found.field("lo").to_numpy().astype(np.int64), found.field("mask").to_numpy()
    k = np.arange(63)
    hit = (mask[:, None] >> k & 1).astype(bool)
    starts = np.unique((lo[:, None] + k)[hit])
    # Starts less than a window apart cover one stretch.
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > window)))
    begin, end = starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)] + window
    n, kept = 0, []
    for _, part in pieces(text, 0):
        lot = part.split()
        place = np.searchsorted(begin, np.arange(n, n + len(lot)), side="right") - 1
        gone = (place >= 0) & (np.arange(n, n + len(lot)) < end[place])
        kept += compress(lot, (~gone).tolist())
        n += len(lot)
    return n, int((end - begin).sum()), b" ".join(kept), [{"start": int(a), "words": int(z - a)} for a, z in zip(begin, end)]
