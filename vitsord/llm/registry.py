"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, language, leakage, mixing, pii, sentences, splitting, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": sentences.p1_found,
        "p2_found": language.p2_found,
        "p2_labels": language.p2_labels,
        "p4_found": pii.p4_found,
        "p4_redacted": pii.p4_redacted,
        "p6_found": leakage.p6_found,
        "p6_items": leakage.p6_items,
        "p6_clean": leakage.p6_clean,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p8_found": toxicity.p8_found,
        "p8_scores": toxicity.p8_scores,
        "p8_rates": toxicity.p8_rates,
        "p5_found": boilerplate.p5_found,
        "p5_content": boilerplate.p5_content,
        "p3_found": splitting.p3_found,
        "p3_pieces": splitting.p3_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {}
