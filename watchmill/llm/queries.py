"""The queries of this package by name."""

from __future__ import annotations

from watchmill.llm.common import Query
from watchmill.llm.infill import OP11_SQL, op11_fill_in_middle
from watchmill.llm.language import op6_language
from watchmill.llm.lexical import OP12_SQL, op12_ranked_search
from watchmill.llm.neighbours import op5_embedding_near_duplicates
from watchmill.llm.packing import op8_pack_documents
from watchmill.llm.pieces import op1_encode_pieces
from watchmill.llm.quality import op13_quality
from watchmill.llm.simhash import op10_simhash_near_duplicates
from watchmill.llm.sketches import op2_fingerprints
from watchmill.llm.surrogates import op9_surrogates
from watchmill.llm.templates import op4_page_text
from watchmill.llm.toxicity import op3_toxicity
from watchmill.llm.urls import op7_url_verdicts

QUERIES: dict[str, Query] = {
    "op1_encode_pieces": op1_encode_pieces,
    "op2_fingerprints": op2_fingerprints,
    "op3_toxicity": op3_toxicity,
    "op4_page_text": op4_page_text,
    "op5_embedding_near_duplicates": op5_embedding_near_duplicates,
    "op6_language": op6_language,
    "op7_url_verdicts": op7_url_verdicts,
    "op8_pack_documents": op8_pack_documents,
    "op9_surrogates": op9_surrogates,
    "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality": op13_quality,
}
#: The other operators cannot be said in SQL; tests/llm compares them with brute force, libraries or held-out rows.
ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": OP11_SQL, "op12_ranked_search": OP12_SQL}
