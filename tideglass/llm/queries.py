"""The queries of this subpackage: opN_<name>, and the pipeline of corpus_pipeline.py."""

from __future__ import annotations

from .chunks import op7_chunks
from .exact_dedup import ORACLE as EXACT_ORACLE
from .exact_dedup import op5_exact_dedup
from .katz import op10_katz
from .language import op1_language
from .licences import op6_licences
from .packing import op9_packing
from .pieces import op4_sentencepiece
from .quality import op2_quality
from .simhash import op8_simhash
from .toxicity import op3_toxicity

QUERIES = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licences": op6_licences,
    "op7_chunks": op7_chunks,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_katz": op10_katz,
}

ORACLES = {"op5_exact_dedup": EXACT_ORACLE}
