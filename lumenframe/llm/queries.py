"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from . import bpe, chat, fingerprints, html_extract, language_id, mixing, quality, sharding, simhash, topk_search
from .common import table

QUERIES = {
    "op1_document_fingerprints": lambda spark, d: fingerprints.op1_query(table(spark, d, "documents")),
    "op2_html_extraction": lambda spark, d: html_extract.op2_query(table(spark, d, "pages")),
    "op3_language_id": lambda spark, d: language_id.op3_query(table(spark, d, "documents")),
    "op4_simhash": lambda spark, d: simhash.op4_query(table(spark, d, "documents")),
    "op5_sharding": lambda spark, d: sharding.op5_query(table(spark, d, "documents")),
    "op6_topk_search": lambda spark, d: topk_search.op6_query(table(spark, d, "embeddings")),
    "op7_mixing": lambda spark, d: mixing.op7_query(table(spark, d, "documents")),
    "op8_bpe": lambda spark, d: bpe.op8_query(table(spark, d, "documents")),
    "op9_chat_formatting": lambda spark, d: chat.op9_query(table(spark, d, "conversations")),
    "op10_quality": lambda spark, d: quality.op10_query(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLE_SQL = {
    "op5_sharding": sharding.OP5_SQL,
    "op6_topk_search": topk_search.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
}
