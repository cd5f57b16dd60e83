"""The queries of the corpus operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from .brown import op9_brown
from .decontaminate import op8_decontaminate
from .matroska import op6_matroska
from .mixing import op3_mixing
from .pii import op5_pseudonyms
from .quality import op2_quality
from .sharding import op4_shards
from .simhash import op7_simhash
from .token_counts import op1_token_counts
from .token_store import op10_token_store

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_shards": op4_shards,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_matroska": op6_matroska,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_brown": op9_brown,
    "op10_token_store": op10_token_store,
}
SQL: dict[str, str] = {}
