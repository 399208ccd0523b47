"""Queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from sheaf.llm import leaks, lookalike, mixture, names, personal, pieces, scan, terms

QUERIES = {
    "p2_found": terms.p2_found,
    "p2_unmatched": terms.p2_unmatched,
    "p3_found": names.p3_found,
    "p3_entities": names.p3_entities,
    "p4_found": lookalike.p4_found,
    "p4_canonical": lookalike.p4_canonical,
    "p6_found": personal.p6_found,
    "p6_redacted": personal.p6_redacted,
    "p7_found": scan.p7_found,
    "p7_repaired": scan.p7_repaired,
    "p8_found": leaks.p8_found,
    "p8_report": leaks.p8_report,
    "p9_mix": mixture.p9_mix,
    "p9_shares": mixture.p9_shares,
    "p10_found": pieces.p10_found,
    "p10_pieces": pieces.p10_pieces,
}
#: None of these operators can be said in SQL: they are tested against brute force and held-out cases in tests/llm.
SQL: dict[str, str] = {}
