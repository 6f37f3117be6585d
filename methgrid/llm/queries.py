"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from .bpe import op7_merge_replay
from .language import op5_byte_conv
from .licenses import op6_conditional_compression
from .minhash import op10_bag_minhash
from .mixing import op1_entropy_mix
from .packing import op11_minimum_slack
from .resample import OP12_SQL, op12_translate_split
from .secrets import op8_linked_secrets
from .sharding import op4_virtual_slots
from .spotsigs import op9_spot_signatures
from .topk import OP3_SQL, op3_score_at_a_time
from .whitening import op13_jacobi_davidson
from .windows import op2_compact_windows

QUERIES = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_compact_windows": op2_compact_windows,
    "op3_score_at_a_time": op3_score_at_a_time,
    "op4_virtual_slots": op4_virtual_slots,
    "op5_byte_conv": op5_byte_conv,
    "op6_conditional_compression": op6_conditional_compression,
    "op7_merge_replay": op7_merge_replay,
    "op8_linked_secrets": op8_linked_secrets,
    "op9_spot_signatures": op9_spot_signatures,
    "op10_bag_minhash": op10_bag_minhash,
    "op11_minimum_slack": op11_minimum_slack,
    "op12_translate_split": op12_translate_split,
    "op13_jacobi_davidson": op13_jacobi_davidson,
}

ORACLE_SQL: dict[str, str] = {
    "op3_score_at_a_time": OP3_SQL,
    "op12_translate_split": OP12_SQL,
}
