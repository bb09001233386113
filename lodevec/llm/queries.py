"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: The vocabulary that op2 and the pipeline encode with; its folder is a parameter.
TOKENIZERS = os.environ.get("LODEVEC_TOKENIZERS", "/opt/tokenizers")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.pii import pii

    return pii(table(spark, sf_dir, "documents"))


def op2_piece_coding(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from lodevec.llm.pieces import PieceModel, encoded

    return encoded(table(spark, sf_dir, "documents"), PieceModel.load(f"{tokenizers}/piece_bpe_32k.model"), decode=True)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.chat import ChatParams, chats, linear, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return read_back(chats(linear(rows), ChatParams(best=1)))  # a conversation is a tree of one branch, its best one


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.mixing import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = (F.size("_copies") * F.col("_size")).cast("long")
    return plan.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodevec.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_piece_coding": op2_piece_coding,
    "op3_near_dedup": op3_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
}

SQL = {
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id),
        top AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN top ON top.id = s.doc_id""",
    "op4_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS said,
                     coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS learned,
                     sum(13 + 2 * length(role) + 2 * length(text) - length(regexp_replace(role, '[\\<|\[]', '', 'g')) - length(regexp_replace(text, '[\\<|\[]', '', 'g')))::BIGINT AS formatted_chars
              FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, strlen(h) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (((('0x' || substr(x, 1 + (5 * i) // 4, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) & 31)::INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
