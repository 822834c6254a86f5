"""Language identification by nearest centroids of TF-IDF vectors.

A text is a vector of hashed letter n-grams, weighted by inverse document frequency over all
training rows and scaled to length one.  Each language is described by several centroids, from
spherical k-means inside the language; a text gets the language of the centroid with the
largest cosine and is rejected if even that one is too far away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fallpoint.llm.common import held, prepared, text_of

UNDETERMINED = "und"
SIZE = 1 << 13  # hashed features
ORDERS = 3  # n-grams of one to three letters
CHUNK = 1 << 20  # code points of a text handled at a time
#: Bound of the sample on which a language's centroids are fitted; frequencies and predictions cover all rows.
SAMPLE_PER_LANGUAGE = 600
CENTROIDS = 4
#: N-grams from which a text is held against the whole floor; a shorter one has a smaller cosine by nature, and a floor
#: smaller with the root of its share.
FULL = 1200


def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letters() -> np.ndarray:
    return held("letters", letter_table)


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams over the lower-case text, where each run of other characters is one blank."""
    total = np.zeros(SIZE, dtype=np.int64)
    is_letter = letters()
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer((" " + text[at:at + CHUNK].lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = is_letter[codes]
        keep = known.copy()
        keep[1:] |= known[:-1]  # the first of other characters stays, as a blank
        keep[0] = True
        codes = np.where(known, codes, np.uint32(32))[keep]
        if len(codes) < 3:
            continue
        gram = codes
        for order in range(1, ORDERS + 1):
            if order > 1:
                gram = gram[:-1] * np.uint32(0x01000193) + codes[order - 1:]
            mixed = (gram ^ np.uint32(order)) * np.uint32(0x9E3779B1)
            total += np.bincount(mixed >> np.uint32(32 - 13), minlength=SIZE)
    return total


def vectors(texts: list[str], idf: np.ndarray, sizes: list | None = None) -> np.ndarray:
    """Rows of length one, or zero for a text without letters; ``sizes`` gets the number of n-grams of each."""
    found = [counts(t) for t in texts]
    if sizes is not None:
        sizes += [int(c.sum()) for c in found]
    x = np.log1p(np.stack(found).astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one; starts from rows far from each other, the first being nearest to the mean."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        # The row at a low quantile of closeness is far from the chosen ones without being the oddest of all.
        chosen.append(int(np.argsort(near, kind="stable")[len(near) // 10]))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


@dataclass
class LanguageModel:
    """idf of the features; for every centroid its language, vector and the cosine below which a text is rejected."""

    idf: np.ndarray
    languages: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE), np.float32))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, reject_share: float = 0.35) -> LanguageModel:
    """Learn from labelled rows; those with a null text or language are left out.

    Document frequencies come from all rows.  The centroids of a language are fitted on about
    ``sample_per_language`` of its rows, drawn by a hash of the id.  A text is rejected below
    ``reject_share`` times the first percentile of its language's cosines in that sample.  The driver
    holds one row per feature and ``centroids`` rows per language.  No rows give a model without languages.
    """
    prepared(rows)
    data = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, dtype=np.int64)
        langs: dict[str, int] = {}
        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                seen += counts(t.as_py()) > 0
                langs[lang] = langs.get(lang, 0) + 1
        at = np.nonzero(seen)[0]
        names = list(langs)
        yield pa.RecordBatch.from_arrays([
            pa.array([None] * len(at) + names, pa.string()), pa.array(at.tolist() + [-1] * len(names), pa.int32()),
            pa.array(seen[at].tolist() + [langs[n] for n in names], pa.int64())], names=["lang", "feature", "n"])

    found = data.select("text", "lang").mapInArrow(frequencies, "lang string, feature int, n long").groupBy("lang", "feature").agg(
        F.sum("n").alias("n")).collect()
    per_lang = {r["lang"]: r["n"] for r in found if r["feature"] < 0}
    total = sum(per_lang.values())
    idf = np.full(SIZE, np.log(1 + total), dtype=np.float32)
    for r in found:
        if r["feature"] >= 0:
            idf[r["feature"]] = np.log((1 + total) / (1 + r["n"])) + 1e-3
    if not per_lang:
        return LanguageModel(idf)
    # One row per language, and the driver holds as many already.
    share = data.sparkSession.createDataFrame([(k, min(1.0, sample_per_language / n)) for k, n in per_lang.items()], "lang string, share double")
    draw: Column = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = data.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def cluster(some: pd.DataFrame) -> pd.DataFrame:
        x = vectors(some["text"].tolist(), idf)
        x = x[(x > 0).any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "vector": [], "floor": []})
        c = spherical_means(x, centroids)
        floor = float(np.quantile((x @ c.T).max(axis=1), 0.01)) * reject_share
        return pd.DataFrame({"lang": some["lang"].iloc[0], "vector": [v.astype("<f4").tobytes() for v in c], "floor": floor})

    got = sorted(sample.groupBy("lang").applyInPandas(cluster, "lang string, vector binary, floor double").collect())
    return LanguageModel(idf, [r["lang"] for r in got], np.stack([np.frombuffer(r["vector"], "<f4") for r in got]) if got else np.zeros((0, SIZE), np.float32),
                         np.array([r["floor"] for r in got]))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns, with lang_pred string, score double (cosine, 0 to 1) and rejected boolean.

    ``und`` with score 0 and rejected for a null text, a text without letters, or a model without
    languages.  Ties go to the language that sorts first.  Existing columns of these names are replaced.
    """
    prepared(docs)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at_text = rest.index(text_col)
    schema = docs.select(*rest).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    names = schema.names
    idf, languages, c, floors = model.idf, np.array(model.languages + [UNDETERMINED], dtype=object), model.centroids.T.copy(), np.append(model.floors, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sizes: list[int] = []
                x = vectors([t.as_py() or "" for t in part.column(at_text)], idf, sizes)
                full = np.sqrt(np.minimum(1.0, np.array(sizes) / FULL))
                blank = ~(x > 0).any(axis=1)
                if c.shape[1]:
                    cosine = x @ c
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(x)), best].astype(np.float64), 0.0, 1.0)
                else:
                    best, score = np.zeros(len(x), dtype=int), np.zeros(len(x))
                    blank[:] = True
                best[blank], score[blank] = len(languages) - 1, 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages[best].tolist(), pa.string()), pa.array(score),
                                                  pa.array(blank | (score < floors[best] * full))], names=names)

    return docs.select(*rest).mapInArrow(run, schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows kept out of learning: CRC-32 of the id as text leaves 2 when divided by 4; a null id is not."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
