"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .fingerprint import op5_fingerprint
from .ftrl import op3_quality
from .htmltext import op2_html
from .linedup import OP8_SQL, op8_lines
from .minhash import OP10_SQL, op10_minhash
from .packing import op7_packing
from .suffixdedup import op1_suffix
from .surrogates import op6_pii
from .topk import OP9_SQL, op9_topk

QUERIES = {f.__name__: f for f in (op1_suffix, op2_html, op3_quality, op4_bpe, op5_fingerprint, op6_pii, op7_packing, op8_lines, op9_topk, op10_minhash)}
ORACLES = {"op8_lines": OP8_SQL, "op9_topk": OP9_SQL, "op10_minhash": OP10_SQL}
