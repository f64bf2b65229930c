"""All queries of this subpackage and the SQL that some of them are checked against."""

from . import op1_ngram_join, op2_chat, op3_toxicity, op4_decontamination, op5_fingerprint, op6_mixing, op7_line_dedup, op8_substring, op9_warc, op10_url_filter

MODULES = (op1_ngram_join, op2_chat, op3_toxicity, op4_decontamination, op5_fingerprint, op6_mixing, op7_line_dedup, op8_substring, op9_warc, op10_url_filter)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
