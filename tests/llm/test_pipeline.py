"""The pipeline's stages on the small documents table, and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fallpoint.llm.queries import QUERIES, SQL
from tests.llm.test_text_ops import plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_every_stage_keeps_what_it_should(stages):
    start, told, exact, near, private, pieces = stages
    assert {r["doc_id"] for r in told} >= {r["doc_id"] for r in start if r["text"] and re.search(r"[^\W\d_]{3}", r["text"])}
    first = {}
    for r in sorted(told, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())
    prints = sorted((r["doc_id"], plain_fingerprint(r["text"])) for r in exact)
    group = {i: i for i, _ in prints}
    for k, (i, x) in enumerate(prints):
        for j, y in prints[:k]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((group[i], group[j]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert {r["doc_id"] for r in near} <= {i for i, g in group.items() if i == g}
    text = {r["doc_id"]: r["text"] for r in near}
    assert {r["doc_id"] for r in private} == set(text)
    mark = re.compile(r"[\w.]+@[\w.]+|\d+\.\d+\.\d+\.\d+|\d{16}|\+1 \(\d{3}\) 555-\d{4}|[0-9a-fA-F]{40}")
    for r in private:
        found = mark.findall(text[r["doc_id"]])
        assert not any(x in r["text"] for x in found) and (found or r["text"] == text[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in pieces} == set(text)


def test_odd_rows_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, None, None, None, None, 0.1), (2, "", "en", "s", 0, 0.1), (3, "the same words again " * 9, "en", "s", 5, 0.1), (3, "the same words again " * 9, "en", "s", 5, 0.1),
            (4, "the same words again " * 9, "en", "s", 5, 0.1), (None, "ein ganz anderer Satz steht hier " * 5, "de", None, None, None)]
    for data, ids in ((rows, [None, 3]), ([], [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted({r["doc_id"] for r in docs.collect()}, key=str) == sorted(ids, key=str)


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert list(corpus_pipeline.QUERIES) == ["pipeline"] and corpus_pipeline.ORACLE_SQL is None
