"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from probelens.llm import decontaminate, filter_audit, merkle, quality_rules, substring_dedup, suffix_dedup, warc
from probelens.llm.decontaminate import op5_decontaminate
from probelens.llm.filter_audit import op12_filter_audit
from probelens.llm.html_extract import op4_html_extract
from probelens.llm.language_id import op7_language_id
from probelens.llm.lm_scoring import op9_lm_scoring
from probelens.llm.merkle import op13_merkle_manifest
from probelens.llm.ngram_jaccard import op1_ngram_jaccard
from probelens.llm.packing import op2_packing
from probelens.llm.quality_rules import op6_quality_rules
from probelens.llm.substring_dedup import op8_substring_dedup
from probelens.llm.suffix_dedup import op11_suffix_dedup
from probelens.llm.toxicity import op3_toxicity
from probelens.llm.warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_packing, op3_toxicity, op4_html_extract, op5_decontaminate, op6_quality_rules, op7_language_id, op8_substring_dedup, op9_lm_scoring, op10_warc, op11_suffix_dedup, op12_filter_audit, op13_merkle_manifest)}

ORACLES: dict[str, str] = {
    "op5_decontaminate": decontaminate.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_suffix_dedup": suffix_dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
