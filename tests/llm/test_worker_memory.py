"""What a Python worker keeps between tasks."""

from fallpoint.llm import common, language_id, packing
from fallpoint.llm.queries import WORD_BPE


def test_the_next_stage_drops_what_the_one_before_left():
    coder = packing.coder_at(WORD_BPE)
    assert packing.coder_at(WORD_BPE) is coder and list(common._HELD.values()) == [coder]
    table = language_id.letters()
    assert language_id.letters() is table and all(v is not coder for v in common._HELD.values())
    assert packing.coder_at(WORD_BPE) is not coder


def test_forgotten_runs_are_encoded_again():
    texts = [" ".join(f"word{k % 7} x{k} été,{k % 3}" for k in range(a, a + 30)).encode() for a in range(0, 300, 10)]
    small, large = packing.ChunkCoder(WORD_BPE), packing.ChunkCoder(WORD_BPE)
    small.LIMIT = 40
    assert [small.encode([t]) for t in texts] == [large.encode([t]) for t in texts] and len(small.memory) < len(large.memory)


def test_stages_send_texts_in_small_batches(spark):
    import corpus_pipeline

    named = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(named)
    try:
        docs = spark.createDataFrame([(1, "a text", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
        for stage in (corpus_pipeline.packing_stage, corpus_pipeline.exact_stage):
            spark.conf.set(named, "10000")
            stage(spark, docs, "")
            assert int(spark.conf.get(named)) <= 512
    finally:
        spark.conf.set(named, before)
