"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from salient.llm.bottomk_dedup import op8_bottomk_dedup
from salient.llm.compression_langid import op11_compression_langid
from salient.llm.decontam import op4_decontam
from salient.llm.dynamic_phrases import OP12_SQL, op12_dynamic_phrases
from salient.llm.fingerprints import op10_fingerprints
from salient.llm.line_spread import OP6_SQL, op6_line_spread
from salient.llm.maxent_lm import op7_maxent_lm
from salient.llm.sentencepiece_spans import op9_sentencepiece
from salient.llm.str_negatives import OP13_SQL, op13_str_negatives
from salient.llm.token_planes import op3_token_planes
from salient.llm.toxicity import op2_toxicity
from salient.llm.url_lm import op1_url_lm
from salient.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_url_lm": op1_url_lm,
    "op2_toxicity": op2_toxicity,
    "op3_token_planes": op3_token_planes,
    "op4_decontam": op4_decontam,
    "op5_warc": op5_warc,
    "op6_line_spread": op6_line_spread,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_bottomk_dedup": op8_bottomk_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_fingerprints": op10_fingerprints,
    "op11_compression_langid": op11_compression_langid,
    "op12_dynamic_phrases": op12_dynamic_phrases,
    "op13_str_negatives": op13_str_negatives,
}

ORACLES: dict[str, str] = {
    "op5_warc": OP5_SQL,
    "op6_line_spread": OP6_SQL,
    "op12_dynamic_phrases": OP12_SQL,
    "op13_str_negatives": OP13_SQL,
}
