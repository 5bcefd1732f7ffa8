"""Every query of this subpackage and the SQL that gives the same rows."""

from windrow.llm import (  # noqa: F401
    attention_mil,
    hard_negatives,
    interleave,
    maxent_lm,
    ngram_quality,
    occurrence_join,
    open_windows,
    positional_index,
    simple8b,
    substring_dedup,
    subword_language,
    token_alignment,
    wrapper,
)
from windrow.llm.registry import ORACLES, QUERIES  # noqa: F401
