"""Registered queries of the corpus operators: name -> (query, DuckDB SQL
or None)."""

from __future__ import annotations

from . import (bpe, fingerprints, line_dedup, merkle, mixing, ngram_model, phrase_mining, quality_model,
               quality_rules, secret_scan, simhash, substring_dedup, warc)

QUERIES = {
    "op1_substring_dedup": (substring_dedup.op1_substring_dedup, substring_dedup.OP1_SQL),
    "op2_line_dedup": (line_dedup.op2_line_dedup, line_dedup.OP2_SQL),
    "op3_warc": (warc.op3_warc, warc.OP3_SQL),
    "op4_secret_scan": (secret_scan.op4_secret_scan, None),
    "op5_bpe": (bpe.op5_bpe, None),
    "op6_mixing": (mixing.op6_mixing, mixing.OP6_SQL),
    "op7_quality_classifier": (quality_model.op7_quality_classifier, None),
    "op8_quality_rules": (quality_rules.op8_quality_rules, None),
    "op9_fingerprints": (fingerprints.op9_fingerprints, None),
    "op10_simhash": (simhash.op10_simhash, None),
    "op11_merkle": (merkle.op11_merkle, merkle.OP11_SQL),
    "op12_ngram_model": (ngram_model.op12_ngram_model, None),
    "op13_phrases": (phrase_mining.op13_phrases, phrase_mining.OP13_SQL),
}
