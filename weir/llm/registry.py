"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from weir.llm.brown_lm import op2_brown_lm
from weir.llm.decontaminate import OP8_SQL, op8_decontaminate
from weir.llm.language_id import op10_language_id
from weir.llm.licenses import OP9_SQL, op9_licenses
from weir.llm.near_dup import op4_near_dup
from weir.llm.nn_descent import op6_nn_descent
from weir.llm.quantile_digest import op13_quantiles
from weir.llm.secrets import op3_secrets
from weir.llm.sentencepiece_bpe import op1_sentencepiece
from weir.llm.simhash_dup import op12_simhash
from weir.llm.substring_dup import op7_substring_dup
from weir.llm.token_counts import op5_token_counts
from weir.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_brown_lm": op2_brown_lm,
    "op3_secrets": op3_secrets,
    "op4_near_dup": op4_near_dup,
    "op5_token_counts": op5_token_counts,
    "op6_nn_descent": op6_nn_descent,
    "op7_substring_dup": op7_substring_dup,
    "op8_decontaminate": op8_decontaminate,
    "op9_licenses": op9_licenses,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash": op12_simhash,
    "op13_quantiles": op13_quantiles,
}

ORACLE_SQL = {
    "op8_decontaminate": OP8_SQL,
    "op9_licenses": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
}
