"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is split into runs (a space and the non-space after it), each distinct run into the
pattern's pieces, and each distinct piece into tokens.  For a short piece the part boundaries
and the ranks of adjacent parts lie in one array: the smallest rank is found by a scan, its
boundary deleted, and the two neighbouring ranks looked up anew.  Pieces of one length are
worked on together, one array row each; a long piece takes the same steps from a heap.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fallpoint.llm.common import prepared, text_of

# Fixed value: the split pattern that byte-level vocabularies of this kind are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 48  # bytes of a piece up to which the array scan is used


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file uses for each byte, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    LIMIT = 700_000  # runs that the memory may hold; beyond, those not met in the latest batch are forgotten

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = {i: bytes(letters[c] for c in w) for w, i in vocab.items()} | {i: w.encode() for w, i in self.special.items()}
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.width = max(self.table) + 1
        self.bytes_of = np.full(self.width, b"", dtype=object)
        for i, data in self.table.items():
            self.bytes_of[i] = data
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in
                 (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        key = np.array([a * self.width + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([c for _, _, c in pairs], dtype=np.int64)
        self.none = len(pairs)  # the rank of a pair that no merge joins
        self.rank_of = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(pairs)))}
        self.split = regex.compile(PATTERN).findall
        space = regex.compile(r"\s").fullmatch
        self.gaps = [" " + c for c in map(chr, range(0x3001)) if space(c)]  # a space that no non-space follows, but at the end
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.runs: dict[str | int, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts, ``none`` where no merge joins them."""
        want = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of pieces of one length, as little-endian unsigned 32-bit numbers."""
        parts = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(len(pieces), -1)]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        who = np.arange(len(pieces))
        done: list[bytes] = [b""] * len(pieces)

        def finish(which: np.ndarray, rows: np.ndarray) -> None:
            data, width = rows.astype("<u4").tobytes(), 4 * rows.shape[1]
            for k, i in enumerate(which.tolist()):
                done[i] = data[k * width:(k + 1) * width]

        while len(who):
            if not ranks.shape[1]:
                finish(who, parts)
                break
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(who)), at]
            live = low < self.none
            finish(who[~live], parts[~live])
            who, parts, ranks, at, low = who[live], parts[live], ranks[live], at[live], low[live]
            n, r = len(who), np.arange(len(who))
            if not n:
                break
            parts[r, at] = self.made[low]
            stay = np.ones(parts.shape, dtype=bool)
            stay[r, at + 1] = False
            parts = parts[stay].reshape(n, -1)
            ranks = ranks[stay[:, 1:]].reshape(n, -1)
            left = at > 0
            ranks[r[left], at[left] - 1] = self.rank(parts[r[left], at[left] - 1], parts[r[left], at[left]])
            right = at < ranks.shape[1]
            ranks[r[right], at[right]] = self.rank(parts[r[right], at[right]], parts[r[right], at[right] + 1])
        return done

    def merge_long(self, piece: bytes) -> bytes:
        """The same of one long piece: smallest rank first, leftmost among equals, from a heap."""
        parts = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(parts)
        before, after, rank_of = list(range(-1, n - 1)), list(range(1, n + 1)), self.rank_of
        heap = [(rank_of[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (parts[x], parts[after[x]])) in rank_of:
                    heapq.heappush(heap, (rank_of[p], x, *p))
        return np.array([p for p in parts if p >= 0], dtype="<u4").tobytes()

    def learn(self, runs: list[str]) -> None:
        """Put the ids of new runs into memory, and of their pieces, which are short runs themselves."""
        split = [self.parts(r) for r in runs]
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for p in set().union(*split).difference(self.runs):
            data = p.encode()
            by_length.setdefault(len(data), []).append((p, data))
        for length, some in by_length.items():
            for at in range(0, len(some), 8192):
                part = some[at:at + 8192]
                ids = self.merge_short([d for _, d in part]) if length <= SHORT else [self.merge_long(d) for _, d in part]
                self.runs.update((p, got) for (p, _), got in zip(part, ids))
        get = self.runs.__getitem__
        self.runs.update((run, b"".join(map(get, pieces))) for run, pieces in zip(runs, split) if len(pieces) > 1)

    def parts(self, run: str) -> list[str]:
        """Pieces of a run by the pattern; letters alone, or with a stop after them, need no search."""
        if run[1:].isalpha() and (run[0] == " " or run[0].isalpha()):
            return [run]
        if len(run) > 2 and run[-1] in ".," and run[1:-1].isalpha() and (run[0] == " " or run[0].isalpha()):
            return [run[:-1], run[-1]]
        return self.split(run)

    def cut(self, text: str) -> list[str]:
        """Runs of a text: a cut stands before each space that a non-space follows.  The pattern never joins across it."""
        first, *more = text.split(" ")
        if not more:
            return [first] if first else []
        if not text.endswith(" ") and not any(g in text for g in self.gaps):
            return [first, *[" " + m for m in more]] if first else [" " + m for m in more]
        out = [first]
        for m in more:
            if m and not m[0].isspace():
                out.append(" " + m)
            else:
                out[-1] += " " + m
        return [r for r in out if r]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; strings of special tokens become their ids."""
        jobs: list[list[str | int]] = []
        for t in texts:
            if self.specials is None or not any(s in t for s in self.special):
                jobs.append(self.cut(t))
                continue
            job, at = [], 0
            for m in self.specials.finditer(t):
                job += [*self.cut(t[at:m.start()]), self.special[m[0]]]
                at = m.end()
            jobs.append([*job, *self.cut(t[at:])])
        used = set().union(*jobs)
        fresh = used.difference(self.runs)
        if len(self.runs) + len(fresh) > self.LIMIT:
            self.runs = {r: self.runs[r] for r in used & self.runs.keys()}
            fresh = used.difference(self.runs)
        whole = [r for r in fresh if r.__class__ is int]  # a special token is its own run
        self.runs.update((i, i.to_bytes(4, "little")) for i in whole)
        self.learn(list(fresh.difference(whole)))
        get = self.runs.__getitem__
        return [np.frombuffer(b"".join(map(get, job)), dtype="<u4") for job in jobs]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character, unknown ids nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        known = (ids >= 0) & (ids < self.width)
        return b"".join(self.bytes_of[ids if known.all() else ids[known]].tolist()).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def codec_at(path: str) -> Codec:
    """One codec per file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _other(data: DataFrame, used: str) -> list[str]:
    return [c for c in data.columns if c != used]


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace the text column by an array of token ids, as the tokenizers library gives without special tokens.

    Null text counts as empty and gives an empty array; all other columns and all rows stay as
    they are; the text itself does not travel back.
    """
    prepared(docs)
    rest = _other(docs, text_col)
    schema = docs.select(*rest).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(vocabulary_path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, 256):
                got = codec.encode([t.as_py() for t in texts[at:at + 256]])
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                flat = np.concatenate(got).astype(np.int32) if len(got) else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                kept = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], ids], names=[*rest, ids_col])

    return docs.select(*rest, text_of(text_col).alias(text_col)).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text of an array of token ids, special tokens included; a null array gives null."""
    prepared(rows)
    schema = rows.select(*_other(rows, text_col)).schema.add(text_col, T.StringType())
    names = [f.name for f in schema][:-1]
    at_ids = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(vocabulary_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [None if not i.is_valid else codec.decode(i.values.to_numpy(zero_copy_only=False)) for i in part.column(at_ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return rows.select(*names).mapInArrow(run, schema)
