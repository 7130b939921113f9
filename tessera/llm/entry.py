"""The opN_ queries and their SQL equivalents."""

from tessera.llm import decontam, html_text, langid, license_scan, line_dedup, mixing, near_dup, pii, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_topk_maxscore": topk.op2_topk_maxscore,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_pii_pseudonyms": pii.op4_pii_pseudonyms,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_html_main_text": html_text.op6_html_main_text,
    "op7_minhash_near_dup": near_dup.op7_minhash_near_dup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_language_id": langid.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op2_topk_maxscore": topk.ORACLE, "op7_minhash_near_dup": near_dup.ORACLE, "op8_license_scan": license_scan.oracle()}
