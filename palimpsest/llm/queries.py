"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from palimpsest.llm import exact_dedup, line_dedup, mixing
from palimpsest.llm.embedding_dedup import op9_embedding_dedup
from palimpsest.llm.exact_dedup import op3_exact_dedup
from palimpsest.llm.jaccard_join import op4_jaccard_join
from palimpsest.llm.language_id import op1_language_id
from palimpsest.llm.line_dedup import op5_line_dedup
from palimpsest.llm.mixing import op8_mixing
from palimpsest.llm.quality import op10_quality
from palimpsest.llm.token_counts import op6_token_counts
from palimpsest.llm.token_files import op2_token_files
from palimpsest.llm.word_bpe import op7_word_bpe

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_word_bpe": op7_word_bpe,
    "op8_mixing": op8_mixing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_quality": op10_quality,
}

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op8_mixing": mixing.SQL,
}
