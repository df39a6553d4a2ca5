"""The queries of this subpackage, and their SQL where there is one."""

from .op1_token_counts import op1_separator_token_counts
from .op2_block_max_topk import ORACLE as TOPK_SQL
from .op2_block_max_topk import op2_block_max_topk
from .op3_toxicity import op3_counterfactual_toxicity
from .op4_suffix_dedup import op4_suffix_array_dedup
from .op5_decontaminate import ORACLE as DECONTAMINATION_SQL
from .op5_decontaminate import op5_benchmark_decontamination
from .op6_mix_sources import ORACLE as MIX_SQL
from .op6_mix_sources import op6_source_mix
from .op7_language_id import op7_rank_order_languages
from .op8_sentence_spans import op8_sentence_span_dedup
from .op9_url_filter import op9_url_language_models
from .op10_jaccard_join import op10_jaccard_parity_join
from .op11_ranked_search import ORACLE as SEARCH_SQL
from .op11_ranked_search import op11_length_stratified_search
from .op12_importance_resampling import ORACLE as RESAMPLING_SQL
from .op12_importance_resampling import op12_head_tail_resampling
from .op13_projection_forest import op13_projection_forest

QUERIES = {
    f.__name__: f
    for f in (
        op1_separator_token_counts,
        op2_block_max_topk,
        op3_counterfactual_toxicity,
        op4_suffix_array_dedup,
        op5_benchmark_decontamination,
        op6_source_mix,
        op7_rank_order_languages,
        op8_sentence_span_dedup,
        op9_url_language_models,
        op10_jaccard_parity_join,
        op11_length_stratified_search,
        op12_head_tail_resampling,
        op13_projection_forest,
    )
}
ORACLES = {"op2_block_max_topk": TOPK_SQL, "op5_benchmark_decontamination": DECONTAMINATION_SQL, "op6_source_mix": MIX_SQL, "op11_length_stratified_search": SEARCH_SQL, "op12_head_tail_resampling": RESAMPLING_SQL}
