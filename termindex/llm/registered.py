"""The registered queries of this package and, where SQL can express them, their SQL."""

from termindex.llm import (chat, cutting_stock, decontamination, fingerprints, infill, jaccard, licenses, line_dedup, merkle,
                           packing, secrets, sharding, toxicity)

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op6_license_scans": licenses.op6_license_scans,
    "op5_decontamination": decontamination.op5_decontamination,
    "op7_packing": packing.op7_packing,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_cutting_stock": cutting_stock.op11_cutting_stock,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
SQL = {
    "op8_chat_formatting": chat.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_fill_in_middle": infill.SQL,
}
