"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from . import chat_format, hard_negatives, jaccard_join, line_rules, url_filter
from .chat_format import op9_chat_format
from .fingerprints import op3_fingerprints
from .hard_negatives import op12_hard_negatives
from .jaccard_join import op1_jaccard_join
from .line_rules import op7_quality_rules
from .lm_scoring import op2_lm_scoring
from .mixing import op5_mix_sources
from .packing import op6_packing
from .periodic_runs import op13_periodic_runs
from .sharding import op4_sharding
from .simhash import op11_simhash
from .toxicity import op10_toxicity
from .url_filter import op8_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_lm_scoring, op3_fingerprints, op4_sharding, op5_mix_sources, op6_packing, op7_quality_rules, op8_url_filter, op9_chat_format, op10_toxicity,
        op11_simhash, op12_hard_negatives, op13_periodic_runs,
    )
}
ORACLES = {
    "op1_jaccard_join": jaccard_join.ORACLE_SQL, "op7_quality_rules": line_rules.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL, "op9_chat_format": chat_format.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
