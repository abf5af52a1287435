"""The queries of the training-data operators and the SQL of those that SQL can state."""

from __future__ import annotations

from . import abuse, encoding, near_duplicates, overlap, packing, pair_defects, proportional, splitting


# Spellings of the test data that differ from a planned one by more than marks need the operator's edit distance.
_BARE = "lower(regexp_replace(regexp_replace(regexp_replace({x}, '[（(]\\s*\\pN+\\s*[)）]', '', 'g'), '[^\\pL\\pN]+', '', 'g'), '类$', ''))"
_TYPED = f"""r AS (SELECT row_id, min(type) AS type FROM qa_pairs WHERE row_id IS NOT NULL GROUP BY row_id), b AS (SELECT {_BARE.format(x="type")} AS b FROM r),
c AS (SELECT p.type, p.target_share, count(b.b) AS n FROM type_plan p LEFT JOIN b ON b.b = {_BARE.format(x="p.type")} GROUP BY p.type, p.target_share)"""


def queries() -> dict:
    return {
        "p1_groups": near_duplicates.p1_groups,
        "p1_found": near_duplicates.p1_found,
        "p2_scores": pair_defects.p2_scores,
        "p2_found": pair_defects.p2_found,
        "p3_report": overlap.p3_report,
        "p3_found": overlap.p3_found,
        "p4_sample": proportional.p4_sample,
        "p4_report": proportional.p4_report,
        "p4_found": proportional.p4_found,
        "p5_pieces": splitting.p5_pieces,
        "p5_found": splitting.p5_found,
        "p6_ids": encoding.p6_ids,
        "p7_containers": packing.p7_containers,
        "p8_scores": abuse.p8_scores,
        "p8_rates": abuse.p8_rates,
        "p8_found": abuse.p8_found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_TYPED} SELECT type FROM c WHERE n < target_share * 0.2 * (SELECT count(*) FROM r)",
        "p5_found": "SELECT DISTINCT message_id FROM chat_messages WHERE length(content) > 2000 AND message_id IS NOT NULL",
    }
