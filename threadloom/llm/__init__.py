"""Preparation of text corpora: tokens, containers, forms, near-duplicates, linkage, personal data, abuse.

Nothing outside this subpackage imports it; its queries and their SQL are collected here.
"""

from __future__ import annotations

from threadloom.llm import abuse, linkage, near_dup, packing, pii, tokens, unicode_forms

QUERIES = {
    "p2_found": abuse.p2_found,
    "p2_scores": abuse.p2_scores,
    "p2_rates": abuse.p2_rates,
    "p3_found": linkage.p3_found,
    "p3_links": linkage.p3_links,
    "p3_clusters": linkage.p3_clusters,
    "p4_found": near_dup.p4_found,
    "p4_groups": near_dup.p4_groups,
    "p5_found": pii.p5_found,
    "p5_redacted": pii.p5_redacted,
    "p5_check": pii.p5_check,
    "p6_ids": tokens.p6_ids,
    "p6_decoded": tokens.p6_decoded,
    "p7_containers": packing.p7_containers,
    "p7_check": packing.p7_check,
    "p8_found": unicode_forms.p8_found,
    "p8_normalized": unicode_forms.p8_normalized,
    "p8_stable": unicode_forms.p8_stable,
}

#: Queries whose result SQL can state over whole tables: round trips and what holds of every result.
SQL: dict[str, str] = pii.SQL | tokens.SQL | packing.SQL | unicode_forms.SQL
