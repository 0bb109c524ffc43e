"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .audio import op8_audio
from .bpe_codec import op5_bpe_codec
from .jaccard_join import op6_jaccard_join
from .license_scan import op9_license_scan
from .line_templates import op7_line_templates
from .order_minhash import op2_order_minhash
from .packing import op10_packing
from .role_repair import op13_role_repair
from .shared_spans import op11_run_index
from .spelling_variants import op12_spelling_variants
from .token_counts import op1_token_counts
from .toxicity import op4_toxicity
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_order_minhash": op2_order_minhash,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_templates": op7_line_templates,
    "op8_audio": op8_audio,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_run_index": op11_run_index,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_role_repair": op13_role_repair,
}

ORACLE_SQL = {"op3_url_filter": OP3_SQL}
