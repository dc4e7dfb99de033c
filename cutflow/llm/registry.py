"""The subpackage's queries, by name, and DuckDB SQL for those that SQL can express."""

from . import alignment, classifier, decontaminate, divergence, hpylm, html_text, licenses, neardup, packing, pii, quality, suffixes, urls

QUERIES = {
    "op1_minhash": neardup.op1_minhash,
    "op2_urls": urls.op2_urls,
    "op3_hpylm": hpylm.op3_hpylm,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_html": html_text.op6_html,
    "op7_quality_classifier": classifier.op7_quality_classifier,
    "op8_pii": pii.op8_pii,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_licenses": licenses.op10_licenses,
    "op11_divergence": divergence.op11_divergence,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_urls": urls.OP2_SQL,
    "op10_licenses": licenses.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
}
