"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .chat import op1_chat_format
from .embed_dedup import op5_embed_dedup
from .html_extract import op7_html_extract
from .infilling import op12_fill_in_middle
from .jaccard_join import op9_jaccard_join
from .langid import op8_langid
from .media import op6_media
from .mixing import op2_mixing
from .oracle import ORACLE_SQL
from .packing import op3_packing
from .pii import op10_pii
from .substring_dedup import op13_substring_dedup
from .toxicity import op4_toxicity

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_mixing, op3_packing, op4_toxicity, op5_embed_dedup, op6_media, op7_html_extract, op8_langid, op9_jaccard_join, op10_pii, op11_token_alignment, op12_fill_in_middle, op13_substring_dedup)}
