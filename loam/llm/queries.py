"""The registered corpus queries, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from loam.llm.bpe import op2_bpe
from loam.llm.embeddings import op1_embeddings
from loam.llm.fingerprints import op10_fingerprints
from loam.llm.html import op8_html
from loam.llm.jaccard import op6_jaccard
from loam.llm.language import op4_language
from loam.llm.mixing import MIXING_SQL, op5_mixing
from loam.llm.toxicity import op7_toxicity
from loam.llm.urls import URLS_SQL, op9_urls
from loam.llm.warc import WARC_SQL, op3_warc

QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_jaccard": op6_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_urls": op9_urls,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op5_mixing": MIXING_SQL,
    "op9_urls": URLS_SQL,
}
