"""The subpackage's queries, and SQL for those that SQL can express."""

from . import decontamination, divergence, html_extraction, language_id, lattice, media, near_duplicates, packing, sharding, substring_dedup, toxicity, warc, whitening

QUERIES = {
    "op1_html_extraction": html_extraction.query,
    "op2_toxicity": toxicity.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_sharding": sharding.query,
    "op5_lattice": lattice.query,
    "op6_decontamination": decontamination.query,
    "op7_packing": packing.query,
    "op8_language_id": language_id.query,
    "op9_near_duplicates": near_duplicates.query,
    "op10_media": media.query,
    "op11_divergence": divergence.query,
    "op12_whitening": whitening.query,
    "op13_warc": warc.query,
}
ORACLES = {"op3_substring_dedup": substring_dedup.ORACLE, "op4_sharding": sharding.ORACLE, "op6_decontamination": decontamination.ORACLE, "op9_near_duplicates": near_duplicates.ORACLE, "op11_divergence": divergence.ORACLE}
