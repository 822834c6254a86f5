"""The named queries of this package on the driver's tables, with check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallpoint.llm.bpe import decode, encode
from fallpoint.llm.chat_format import format_chats, read_chats
from fallpoint.llm.cotraining import classify_quality
from fallpoint.llm.exact_dedup import exact_dedup
from fallpoint.llm.html_extract import extract_main
from fallpoint.llm.language_id import fit, held_out, identify
from fallpoint.llm.packing import pack
from fallpoint.llm.pii import pseudonymise
from fallpoint.llm.prefix_trie import borrowed_prefixes, prefix_trie
from fallpoint.llm.quality_rules import quality_rules
from fallpoint.llm.simhash import simhash_dedup
from fallpoint.llm.substring_dedup import substring_dedup
from fallpoint.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: The key of the surrogates; whoever runs this on real data gives one of their own.
PII_KEY = "public example key"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query("op1_simhash_dedup")
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_html_extract")
def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE)
    return decode(ids, BYTE_BPE).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op5_pii_surrogates")
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), PII_KEY, count_col="n_replaced")


@query("op6_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"),
                            table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_chat_format", """
    WITH every AS (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM every),
    told AS (
        SELECT *, replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '</turn>', '<\\/turn>') AS e_text,
               replace(replace(replace(replace(role, '\\', '\\\\'), '#', '\\#'), '</turn>', '<\\/turn>'), ':', '\\:') AS e_role,
               coalesce(lag(role) OVER turns <> role, TRUE) AS opens
        FROM clean WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(e_text) + 7 + CASE WHEN opens THEN 7 + length(e_role) ELSE 0 END) AS BIGINT) AS formatted_chars
    FROM told GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_chats(format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)))
    said_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_prefix_trie", """
    WITH own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    low AS (SELECT unnest(range(256)) AS v),
    crc_table AS (
        WITH RECURSIVE step(v, k, c) AS (
            SELECT v, 0, v::UBIGINT FROM low UNION ALL
            SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE k < 8)
        SELECT list(c ORDER BY v) AS t FROM step WHERE k = 8),
    ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM own),
    h AS (
        SELECT conv_id, base, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(str_split(CAST(conv_id AS VARCHAR), ''),
                   lambda x: ascii(x)::UBIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 6 AS INT) AS h
        FROM ids, crc_table),
    lent AS (SELECT h.conv_id, o.pos, o.role, o.text FROM h JOIN own o ON o.conv_id = h.base AND o.pos <= h.h),
    turns AS (
        SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth
        FROM (SELECT conv_id, 0 AS side, pos, role, text FROM lent
              UNION ALL SELECT o.conv_id, 1, o.pos, o.role, o.text FROM own o JOIN h USING (conv_id) WHERE o.pos > h.h)),
    paths AS (
        SELECT conv_id, depth, length(text) AS chars,
               sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path
        FROM turns
        UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
    parents AS (SELECT a.*, b.path AS above FROM paths a LEFT JOIN paths b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
    last AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
    nodes AS (
        SELECT path, any_value(above) AS above, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
        FROM parents JOIN last USING (conv_id) GROUP BY path),
    below AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
    worth AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN below USING (path)),
    sums AS (
        SELECT p.path, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.chars) AS BIGINT) AS saved_tokens
        FROM worth w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.path)
    SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
    FROM worth w JOIN sums s USING (path) LEFT JOIN nodes u ON u.path = w.above""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, turns = borrowed_prefixes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie(ids, turns)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_substring_dedup", r"""
    WITH told AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    placed AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM told),
    windows AS (SELECT r, pos, word, string_agg(word, ' ') OVER w AS said, count(*) OVER w AS n
                FROM placed WINDOW w AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    again AS (SELECT said FROM windows WHERE n = 35 GROUP BY said HAVING count(*) > 1),
    marked AS (SELECT w.r, w.pos, w.word, CASE WHEN a.said IS NULL THEN 0 ELSE 1 END AS hit FROM windows w LEFT JOIN again a ON a.said = w.said AND w.n = 35),
    covered AS (SELECT r, pos, word, max(hit) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
    kept AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM covered GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM told LEFT JOIN kept USING (r)""")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
