"""The registered queries of this subpackage and the SQL that states their results."""

from .decontaminate import op5_benchmark_decontamination
from .embedding_join import OP13_SQL, op13_embedding_near_dedup
from .html_text import op6_html_extraction
from .importance import OP11_SQL, op11_importance_resampling
from .jaccard_join import OP3_SQL, op3_ngram_jaccard_join
from .packing import op10_packing
from .quality_rules import op8_quality_rules
from .secret_scan import op2_secret_scan
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_counts import op9_token_counts
from .token_output import op7_token_output
from .url_filters import OP4_SQL, op4_url_filters
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_ngram_jaccard_join, op4_url_filters, op5_benchmark_decontamination, op6_html_extraction, op7_token_output, op8_quality_rules, op9_token_counts, op10_packing, op11_importance_resampling, op12_vector_codes, op13_embedding_near_dedup)}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op4_url_filters": OP4_SQL, "op11_importance_resampling": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_embedding_near_dedup": OP13_SQL}
