"""Packing token sequences into fixed windows by the sum-of-squares rule, online.

Every task packs the documents it reads, in the order it reads them: nothing is shuffled.
A document that is longer than a window fills whole windows first; what is left over goes to
the fill level that makes the sum of squared counts of partly filled windows smallest.  At
the end of a task the windows still open are laid end to end and cut at window bounds, and
the last rest is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.bpe import byte_letters
from fallpoint.llm.common import held, prepared, text_of

WINDOW = 2048
END_ID = 1

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Levels:
    """Open windows by fill level, and the level that a piece of a given length should go to."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # level 0 and a full window count nothing
        self.open: list[list] = [[] for _ in range(window)]

    def choose(self, length: int) -> int:
        """Moving a window from level h to h + length changes the sum of squares by 2 (n[h + length] - n[h] + 1),
        by 2 n[length] + 1 for a new window and by 1 - 2 n[h] for one that gets full; the first smallest level wins."""
        n, top = self.count, self.window - length
        change = 2 * (n[length:self.window + 1] - n[:top + 1]) + 2
        change[top] = 1 - 2 * n[top]
        change[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[length] + 1 if length < self.window else 0
        return int(change.argmin())


class ChunkCoder:
    """Token ids of whole texts through the tokenizers library, one call per distinct run of non-space bytes.

    The file's pattern never joins characters across white space, so a text's ids are its
    runs' ids one after the other; that is checked against the file's pre-tokenizer when it opens.
    """

    LIMIT = 400_000  # runs that the memory may hold; beyond, those met once only are forgotten

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        probe = "ab, cd\tef\n\n gh's  <|x|>éè 1.2"
        parts = [i for w in probe.encode().split() for i in self.tokenizer.encode(w.decode(), add_special_tokens=False).ids]
        if parts != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError("this vocabulary joins characters across white space")
        self.memory: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()
        # Of small Latin letters alone the file's normaliser and split change nothing, so the model can be asked directly.
        spec = json.loads(self.tokenizer.to_str())
        self.lower = any(n.get("type") == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        self.plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
        self.odd = re.compile(rb"[.,](?=[ \n])(?<![a-z].)(?<!\xc3[\x9f-\xb6\xb8-\xbf].)").search
        self.direct = self.tokenizer.model.tokenize
        self.letters = {b: letter for letter, b in byte_letters().items()}
        words = ["the", "therefore", "qxzzjkw", "aaaaaaaaaaaa", "s", "interestingly", "\xe0\xed\xdf", "stra\xdfe", "\xea\xe9t\xe9"]
        if any(self.ask(w.encode()) != self.tokenizer.encode(w, add_special_tokens=False).ids for w in words):
            self.plain = lambda run: None

    def ask(self, run: bytes) -> list[int]:
        return [t.id for t in self.direct(run.decode("latin-1").translate(self.letters))]

    def runs(self, text: bytes) -> list[bytes]:
        """Runs of a text.  Where the file lowers letters they are lowered before, and a comma or full stop between
        a letter and white space, which is a piece of its own, is set apart: fewer distinct runs, the same ids."""
        small = text.lower() if self.lower else text
        if small is text or any(m in small for m in self.marks):
            return text.split()
        text = small
        if not self.odd(text):
            text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" , ").replace(b".\n", b" . ")
        return text.split()

    def learn(self, runs: list[bytes]) -> None:
        """Encode new runs: plain words one by one, the others as one text, where their places tell whose the tokens are."""
        other = []
        for r in runs:
            if self.plain(r):
                self.memory[r] = struct.pack(f"<{len(ids := self.ask(r))}I", *ids)
            else:
                other.append(r)
        if not (runs := other):
            return
        words = [r.decode() for r in runs]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        got = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4")
        places = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        data, cuts = ids.tobytes(), (np.searchsorted(places, starts) * 4).tolist()
        self.memory.update((r, data[a:b]) for r, a, b in zip(runs, cuts, cuts[1:]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.runs(t) for t in texts]
        used = set().union(*split)
        new = list(used.difference(self.memory))
        if len(self.memory) + len(new) > self.LIMIT:
            self.again &= self.memory.keys()
            self.memory = {r: self.memory[r] for r in self.again | (used & self.memory.keys())} if len(self.again) < self.LIMIT // 2 else {}
            self.again = set()
            new = list(used.difference(self.memory))
        self.again.update(used.difference(new))
        for at in range(0, len(new), 4096):
            self.learn(new[at:at + 4096])
        get = self.memory.__getitem__
        return [b"".join(map(get, runs)) for runs in split]


def coder_at(path: str) -> ChunkCoder:
    """One coder per file and Python worker."""
    return held(("coder", path), lambda: ChunkCoder(path))


def pack_task(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) in, pieces out; see ``pack``."""
    coder, levels = coder_at(path), Levels(window)
    next_id = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    size = 0
    end = np.array([end_id], dtype="<u4").tobytes()

    def out(piece: tuple, sequence: int, offset: int) -> None:
        nonlocal size
        rows.append((*piece, sequence, offset))
        size += len(piece[3])

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
        rows, size = [], 0
        return made

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids), 64):
            data = coder.encode([t.as_py().encode() for t in texts[at:at + 64]])
            for doc, tokens in zip(ids[at:at + 64], data):
                tokens += end
                total = len(tokens) // 4
                whole = total // window * window
                for start in range(0, whole, window):
                    out((doc, start, window, tokens[4 * start:4 * (start + window)], total), next_id, 0)
                    next_id += 1
                if whole == total:
                    continue
                piece = (doc, whole, total - whole, tokens[4 * whole:], total)
                level = levels.choose(piece[2])
                if level:
                    sequence, held = levels.open[level].pop()
                    levels.count[level] -= 1
                else:
                    sequence, held, next_id = next_id, [], next_id + 1
                held.append(piece)
                if level + piece[2] == window:
                    offset = 0
                    for p in held:
                        out(p, sequence, offset)
                        offset += p[2]
                else:
                    levels.open[level + piece[2]].append((sequence, held))
                    levels.count[level + piece[2]] += 1
            if size > 4_000_000:
                yield flush()
    left = [p for level in reversed(levels.open) for _, held in level for p in held]
    rest = sum(p[2] for p in left)
    sizes = [window] * (rest // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest % window >> b & 1]
    offset = 0
    for doc, start, length, tokens, total in left:
        done = 0
        while done < length:
            take = min(length - done, sizes[0] - offset)
            out((doc, start + done, take, tokens[4 * done:4 * (done + take)], total), next_id, offset)
            done, offset = done + take, offset + take
            if offset == sizes[0]:
                sizes.pop(0)
                next_id, offset = next_id + 1, 0
        if size > 4_000_000:
            yield flush()
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of every text, and ``end_id`` after its last, lies in exactly one piece; offsets in a
    sequence have no gap.  A null or empty text is the end id alone; a null id stays null; repeated
    rows are packed each on its own; an empty table gives no rows; other columns are ignored.
    A task holds the pieces of its open windows only.
    """
    prepared(docs)
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(
        lambda batches: pack_task(batches, tokenizer_path, window, end_id),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    ).withColumnRenamed("doc_id", id_col)
