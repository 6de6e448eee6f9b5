"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from sensorfill.llm.codes import OP11_SQL, op11_vector_codes
from sensorfill.llm.decontaminate import op6_decontaminate
from sensorfill.llm.language import op12_language
from sensorfill.llm.licenses import op9_licenses
from sensorfill.llm.lines import OP5_SQL, op5_line_dedup
from sensorfill.llm.mixing import OP8_SQL, op8_mixing
from sensorfill.llm.passages import op10_substring_dedup
from sensorfill.llm.shards import op3_shards
from sensorfill.llm.simhash import op7_simhash
from sensorfill.llm.token_counts import op4_token_counts
from sensorfill.llm.topk import OP1_SQL, op1_topk
from sensorfill.llm.toxicity import op2_toxicity
from sensorfill.llm.whitening import op13_whitening

QUERIES = {
    "op1_topk": op1_topk,
    "op2_toxicity": op2_toxicity,
    "op3_shards": op3_shards,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_language": op12_language,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_mixing": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
}
