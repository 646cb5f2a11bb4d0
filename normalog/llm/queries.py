"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from normalog.llm.bpe_codec import op10_bpe_codec
from normalog.llm.chat_tree import op9_chat_tree
from normalog.llm.disclosure import op7_disclosure
from normalog.llm.fingerprint_sketch import op2_fingerprint
from normalog.llm.mixing import op4_mixing
from normalog.llm.ppm import op5_ppm
from normalog.llm.quality_hosts import ORACLE as OP6_SQL
from normalog.llm.quality_hosts import op6_quality_hosts
from normalog.llm.repeats import op8_repeats
from normalog.llm.simhash import op3_simhash
from normalog.llm.token_counts import op1_token_counts

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_fingerprint, op3_simhash, op4_mixing, op5_ppm, op6_quality_hosts, op7_disclosure, op8_repeats, op9_chat_tree, op10_bpe_codec)}
ORACLES = {"op6_quality_hosts": OP6_SQL}
