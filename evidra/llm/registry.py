"""The queries and SQL of this folder."""

from __future__ import annotations

from .bpe_transducer import op6_byte_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .fingerprints import op9_fingerprints
from .hard_negatives import op13_hard_negatives
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import op4_mix_sources
from .periodic_runs import op11_periodic_runs
from .rule_quality import op8_rule_quality
from .secret_scan import op3_secret_scan
from .simhash import op1_simhash
from .token_counts import op12_token_counts
from .token_files import op5_token_files
from .url_filter import op7_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_files": op5_token_files,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_rule_quality": op8_rule_quality,
    "op9_fingerprints": op9_fingerprints,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op2_line_dedup": OP2_SQL, "op10_exact_dedup": OP10_SQL}
