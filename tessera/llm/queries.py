"""The llm operators over their whole tables, by query name, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, decontaminate, hilbert_shards, jaccard_join, packing, periodic_runs, pii, quality_rules, site_quality, toxicity, url_rules, whitening
from tessera.llm.shared import Scratch, table

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS rules(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).drop("url")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, length=2048)
    return packed.select(
        F.col("segments.doc_id").alias("doc_ids"),
        F.col("segments.part").alias("parts"),
        "cu_seqlens",
        "n_tokens",
        F.sha2(F.array_join("ids", ",", "null"), 256).alias("ids_sha256"),
        F.sha2(F.array_join("positions", ",", "null"), 256).alias("positions_sha256"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = site_quality.judge(docs, table(spark, sf_dir, "labels"), host="source", path="lang")
    return judged.select("doc_id", "doc_score", "host_rate", "path_rate", "quality_score", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    narrow = Scratch(spark).keep(docs, "narrow")  # texts are read once
    placed = hilbert_shards.shard(narrow, ["lang", "source", "size"], ["text_hash", "doc_id"], shards=8, together="text_hash")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS said(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.digests(chat_format.format_chats(turns))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_repeats(docs)))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, "embedding", components=16, scale=64, offset=1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_packing": op5_token_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pii": op12_pii,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), lists AS (
            SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS ss FROM words
        ), shingles AS (SELECT DISTINCT doc_id, unnest(ss) AS s FROM lists),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.top = e.a)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(top) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
    """,
    "op3_url_filters": r"""
        WITH cut AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '^(?:.|\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), rules(h, p, v) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        )
        SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(v, length(h || p)), 'allow') AS verdict
        FROM cut LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id, host, path
    """,
    "op10_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), marked AS (
            SELECT *, coalesce(lag(role) OVER w <> role, true) AS begins,
                   length(text) + length(regexp_replace(text, '[^~<\[\]]', '', 'g')) AS coded,
                   length(role) + length(regexp_replace(role, '[^~<\[\]]', '', 'g')) AS coded_role
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(7 + sum(coded) + sum(CASE WHEN begins THEN 14 + coded_role ELSE 6 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
}
