"""The corpus queries by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import DIVERGENCE_SQL, op12_source_divergence
from .fertility import op3_fertility_rules
from .media import op2_media_tiles
from .html_text import op4_html_text
from .language import op9_language_id
from .line_dedup import op5_line_dedup
from .mixing import op6_domain_mixing
from .packing import op10_config_lp_packing
from .repair import op1_repair_shards
from .simhash import op8_simhash_near_dedup
from .stable_knn import op11_stable_knn
from .token_counts import op7_token_counts
from .whitening import op13_exact_whitening

OPERATORS = (
    op1_repair_shards, op2_media_tiles, op3_fertility_rules, op4_html_text, op5_line_dedup, op6_domain_mixing, op7_token_counts,
    op8_simhash_near_dedup, op9_language_id, op10_config_lp_packing, op11_stable_knn, op12_source_divergence, op13_exact_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": DIVERGENCE_SQL}
