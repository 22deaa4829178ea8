"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import encoding, language, leaks, membership, packing, pages, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": language.p2_found,
    "p2_document_languages": language.p2_document_languages,
    "p2_segments": language.p2_segments,
    "p3_found": membership.p3_found,
    "p3_filter_errors": membership.p3_filter_errors,
    "p5_method": pages.p5_method,
    "p5_found": pages.p5_found,
    "p6_found": encoding.p6_found,
    "p6_pairs": encoding.p6_pairs,
    "p7_found": pages.p7_found,
    "p7_residue_by_status": pages.p7_residue_by_status,
    "p8_pack": packing.p8_pack,
    "p8_fill": packing.p8_fill,
    "p9_found": leaks.p9_found,
    "p9_leaked_items": leaks.p9_leaked_items,
    "p10_found": truncation.p10_found,
    "p10_source_rates": truncation.p10_source_rates,
}

SQL: dict[str, str] = {
    "p3_found": membership.P3_SQL,
}
