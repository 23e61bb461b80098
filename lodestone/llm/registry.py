"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lodestone.llm import bpe, byte_dedup, license_scan, media, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_count


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_suffix_array_dedup": byte_dedup.op2_suffix_array_dedup,
        "op3_telephony_media": media.op3_telephony_media,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_token_count": token_count.op8_token_count,
        "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    }


#: Words with their places; each place's window of 50; the smallest document that holds it; what windows cover.
SUBSTRING_DEDUP = r"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM split),
windows AS (SELECT doc_id, place, word, CASE WHEN count(*) OVER w = 50 THEN md5(string_agg(word, ' ') OVER w) END AS body FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
first AS (SELECT body, min(doc_id) AS least FROM windows WHERE body IS NOT NULL GROUP BY body),
hits AS (SELECT doc_id, place, word, coalesce(least < doc_id, false) AS hit FROM windows LEFT JOIN first USING (body)),
gone AS (SELECT doc_id, place, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS body FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_DEDUP}
