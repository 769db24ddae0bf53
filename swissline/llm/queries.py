"""Registered queries of the text operators."""

from __future__ import annotations

from swissline.llm.alignment import op11_token_alignment
from swissline.llm.chat import op12_chat_rendering
from swissline.llm.jaccard import op9_jaccard_groups
from swissline.llm.language_model import op4_recurrent_scores
from swissline.llm.lines import op6_line_dedup
from swissline.llm.media import op10_media_sequences
from swissline.llm.mixing import op1_pfair_mixing
from swissline.llm.negatives import op13_bit_sliced_negatives
from swissline.llm.oracles import ORACLES  # noqa: F401
from swissline.llm.packing import op8_deficit_packing
from swissline.llm.quality import op5_quality_repetition
from swissline.llm.substring import op3_substring_dedup
from swissline.llm.suffix_dedup import op7_suffix_dedup
from swissline.llm.toxicity import op2_toxicity_lexicon

QUERIES = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_toxicity_lexicon": op2_toxicity_lexicon,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_recurrent_scores": op4_recurrent_scores,
    "op5_quality_repetition": op5_quality_repetition,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_deficit_packing": op8_deficit_packing,
    "op9_jaccard_groups": op9_jaccard_groups,
    "op10_media_sequences": op10_media_sequences,
    "op11_token_alignment": op11_token_alignment,
    "op12_chat_rendering": op12_chat_rendering,
    "op13_bit_sliced_negatives": op13_bit_sliced_negatives,
}
