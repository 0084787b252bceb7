"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import cleaning, decontam, langid, linededup, maxent, mixing, neardup, quotes, simhash, suffixes, tries, warc, whitening

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_quotes": quotes.op2_quotes,
    "op3_near_vectors": neardup.op3_near_vectors,
    "op4_mixing": mixing.op4_mixing,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_langid": langid.op6_langid,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_lm_score": maxent.op9_lm_score,
    "op10_warc": warc.op10_warc,
    "op11_quality_rules": cleaning.op11_quality_rules,
    "op12_whitening": whitening.op12_whitening,
    "op13_prefix_trie": tries.op13_prefix_trie,
}

ORACLES = {
    "op1_line_dedup": linededup.ORACLE,
    "op2_quotes": quotes.ORACLE,
    "op3_near_vectors": neardup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_quality_rules": cleaning.ORACLE,
    "op13_prefix_trie": tries.ORACLE,
}
