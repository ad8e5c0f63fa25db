"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from sparkcurate.llm.bpe import op10_bpe
from sparkcurate.llm.language import op2_language
from sparkcurate.llm.leaks import LEAKS_SQL, op6_leaks
from sparkcurate.llm.licenses import LICENSES_SQL, op8_licenses
from sparkcurate.llm.lines import op5_lines
from sparkcurate.llm.lm import LM_SQL, op3_lm
from sparkcurate.llm.near import op4_near
from sparkcurate.llm.phrases import PHRASES_SQL, op13_phrases
from sparkcurate.llm.pii import op7_pii
from sparkcurate.llm.quality import QUALITY_SQL, op1_quality
from sparkcurate.llm.records import op9_records
from sparkcurate.llm.search import SEARCH_SQL, op12_search
from sparkcurate.llm.tokens import op11_tokens

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_lm": op3_lm,
    "op4_near": op4_near,
    "op5_lines": op5_lines,
    "op6_leaks": op6_leaks,
    "op7_pii": op7_pii,
    "op8_licenses": op8_licenses,
    "op9_records": op9_records,
    "op10_bpe": op10_bpe,
    "op11_tokens": op11_tokens,
    "op12_search": op12_search,
    "op13_phrases": op13_phrases,
}

ORACLE = {
    "op1_quality": QUALITY_SQL,
    "op3_lm": LM_SQL,
    "op6_leaks": LEAKS_SQL,
    "op8_licenses": LICENSES_SQL,
    "op12_search": SEARCH_SQL,
    "op13_phrases": PHRASES_SQL,
}
