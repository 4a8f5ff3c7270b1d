"""Queries of the twelve operators, by their names in the driver contract."""

from . import chat, decontaminate, fim, langid, licenses, neardup, neighbours, oracle, packing, simhash, substrings, toxicity, urls


def queries() -> dict:
    return {
        "op1_url_filter": urls.op1,
        "op2_license_scan": licenses.op2,
        "op3_nearest_neighbours": neighbours.op3,
        "op4_substring_dedup": substrings.op4,
        "op5_packing": packing.op5,
        "op6_chat_formatting": chat.op6,
        "op7_language_id": langid.op7,
        "op8_toxicity": toxicity.op8,
        "op9_ngram_jaccard_join": neardup.op9,
        "op10_benchmark_decontamination": decontaminate.op10,
        "op11_fill_in_middle": fim.op11,
        "op12_simhash_near_dedup": simhash.op12,
        "near_duplicate_links": neardup.links,
    }


def oracle_sql() -> dict:
    """SQL where it can express the operator; the others are tested against brute force or held-out rows."""
    return {
        "op4_substring_dedup": oracle.OP4,
        "op6_chat_formatting": oracle.OP6,
        "op9_ngram_jaccard_join": oracle.OP9,
        "op10_benchmark_decontamination": oracle.OP10,
        "op11_fill_in_middle": oracle.OP11,
        "near_duplicate_links": oracle.LINKS,
    }
