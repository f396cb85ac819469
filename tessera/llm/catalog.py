"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alike, neighbours, oracles, packing, proportions, quality, stable, together, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": proportions.p1_found,
        "p1_report": proportions.p1_report,
        "p1_sample": proportions.p1_sample,
        "p2_found": stable.p2_found,
        "p2_sample": stable.p2_sample,
        "p3_found": together.p3_found,
        "p3_assign": together.p3_assign,
        "p3_report": together.p3_report,
        "p4_found": alike.p4_found,
        "p4_groups": alike.p4_groups,
        "p5_found": neighbours.p5_found,
        "p5_neighbours": neighbours.p5_neighbours,
        "p6_ids": tokens.p6_ids,
        "p7_found": packing.p7_found,
        "p7_pack": packing.p7_pack,
        "p7_report": packing.p7_report,
        "p8_found": quality.p8_found,
        "p8_flags": quality.p8_flags,
        "p8_profile": quality.p8_profile,
        "p8_stats": quality.p8_stats,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
