"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from strandflow.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from strandflow.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from strandflow.llm.fingerprints import op4_imatch_fingerprints
from strandflow.llm.html_extraction import op1_html_extraction
from strandflow.llm.lm_scoring import op7_lm_scoring
from strandflow.llm.mixing import op10_mixing_weights
from strandflow.llm.ngram_join import OP3_SQL, op3_ngram_jaccard
from strandflow.llm.packing import op9_best_fit_packing
from strandflow.llm.source_audit import OP11_SQL, op11_source_audit
from strandflow.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from strandflow.llm.topk_search import OP8_SQL, op8_topk_search
from strandflow.llm.toxicity import op5_toxicity
from strandflow.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_imatch_fingerprints": op4_imatch_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_topk_search": op8_topk_search,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_mixing_weights": op10_mixing_weights,
    "op11_source_audit": op11_source_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_ngram_jaccard": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op8_topk_search": OP8_SQL,
    "op11_source_audit": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
