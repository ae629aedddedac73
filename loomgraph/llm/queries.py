"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from loomgraph.llm.html_extraction import op8_html_extraction
from loomgraph.llm.language_id import op9_language_id
from loomgraph.llm.mixing import OP6_SQL, op6_mixing
from loomgraph.llm.ngram_join import OP3_SQL, op3_ngram_join
from loomgraph.llm.packing import op1_packing
from loomgraph.llm.pii import op10_pii
from loomgraph.llm.quality_rules import op4_quality_rules
from loomgraph.llm.sharding import op5_sharding
from loomgraph.llm.substring_dedup import op2_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_quality_rules": op4_quality_rules,
        "op5_sharding": op5_sharding,
        "op6_mixing": op6_mixing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_language_id": op9_language_id,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op6_mixing": OP6_SQL, "op7_exact_dedup": OP7_SQL}
