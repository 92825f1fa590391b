"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from .exact_dedup import op8_exact_dedup
from .jaccard import op5_ngram_jaccard_join
from .licenses import op9_license_scans
from .materialise import op7_token_output
from .packing import op1_best_fit_packing
from .ppm import op6_lm_scoring
from .quality import op10_quality_rules
from .sentencepiece_trie import op4_sentencepiece
from .sharding import op2_sharding
from .sql import ORACLE_SQL
from .stringkernel import op3_language_id

QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_best_fit_packing, op2_sharding, op3_language_id, op4_sentencepiece, op5_ngram_jaccard_join, op6_lm_scoring, op7_token_output, op8_exact_dedup, op9_license_scans, op10_quality_rules)}

__all__ = ["ORACLE_SQL", "QUERIES"]
