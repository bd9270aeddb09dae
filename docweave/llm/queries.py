"""The queries opN_* of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import chat, licenses, lines, mixing, packing, quality, sampling, simhash, substring, urlfilter


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_url_filter": urlfilter.query,
        "op3_chat_format": chat.query,
        "op4_substring_dedup": substring.query,
        "op5_simhash": simhash.query,
        "op6_quality": quality.query,
        "op7_packing": packing.query,
        "op8_line_dedup": lines.query,
        "op9_licenses": licenses.query,
        "op10_fingerprints": sampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urlfilter.SQL, "op3_chat_format": chat.SQL, "op4_substring_dedup": substring.SQL, "op9_licenses": licenses.SQL}
