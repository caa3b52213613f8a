"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, hamming, htmltext, importance, langid, licenses, linededup, media, mixing, ngramjoin, oracles, secrets
from .common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_html_text": lambda spark, d: htmltext.extract_text(table(spark, d, "pages")),
    "op2_decontamination": lambda spark, d: decontam.contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op3_license_scan": lambda spark, d: licenses.license_digest(table(spark, d, "documents")),
    "op4_chat_format": lambda spark, d: chat.chat_digest(chat.with_probe(table(spark, d, "conversations"))),
    "op5_language_id": lambda spark, d: langid.language_digest(table(spark, d, "documents")),
    "op6_ngram_jaccard": lambda spark, d: ngramjoin.near_duplicate_digest(table(spark, d, "documents")),
    "op7_line_dedup": lambda spark, d: linededup.line_digest(table(spark, d, "documents")),
    "op8_media_columns": lambda spark, d: media.media_digest(table(spark, d, "documents")),
    "op9_mixing": lambda spark, d: mixing.mixture_digest(table(spark, d, "documents")),
    "op10_secret_scan": lambda spark, d: secrets.secret_digest(table(spark, d, "documents"), f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"),
    "op11_nearest_neighbours": lambda spark, d: hamming.neighbour_digest(table(spark, d, "embeddings")),
    "op12_source_divergence": lambda spark, d: divergence.source_divergence(table(spark, d, "documents")),
    "op13_importance_resampling": lambda spark, d: importance.importance_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLES: dict[str, str] = {
    "op2_decontamination": oracles.CONTAMINATION_SQL,
    "op3_license_scan": oracles.LICENSE_SQL,
    "op4_chat_format": chat.CHAT_SQL,
    "op6_ngram_jaccard": oracles.JACCARD_SQL,
    "op7_line_dedup": oracles.LINE_SQL,
    "op9_mixing": mixing.MIXTURE_SQL,
    "op10_secret_scan": secrets.SECRETS_SQL,
    "op12_source_divergence": divergence.DIVERGENCE_SQL,
    "op13_importance_resampling": importance.IMPORTANCE_SQL,
}
