"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import clustering, decontamination, language, language_model, licenses, mixing, neighbours, phrases, secret_scan, simhash, token_counts, url_filter, warc


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_simhash": simhash.op2_simhash,
        "op3_lm_scores": language_model.op3_lm_scores,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_nearest": neighbours.op5_nearest,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_language_id": language.op8_language_id,
        "op9_warc": warc.op9_warc,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_url_filter": url_filter.op11_url_filter,
        "op12_centroids": clustering.op12_centroids,
        "op13_collocations": phrases.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan.oracle(),
        "op5_nearest": neighbours.oracle(),
        "op7_decontamination": decontamination.oracle(),
        "op9_warc": warc.oracle(),
        "op10_license_scan": licenses.oracle(),
        "op11_url_filter": url_filter.oracle(),
        "op12_centroids": clustering.oracle(),
        "op13_collocations": phrases.oracle(),
    }
