"""The queries of this subpackage and the SQL that gives the same rows."""

from quarry.llm import bpe, decontaminate, exact_dedup, html_text, jaccard_join, licenses, pitman_yor, quality, sharding, toxicity


def queries() -> dict:
    found = [quality.op1_quality, sharding.op2_sharding, licenses.op3_licenses, exact_dedup.op4_exact_dedup, jaccard_join.op5_jaccard, bpe.op6_bpe, toxicity.op7_toxicity, decontaminate.op8_decontaminate, pitman_yor.op9_lm, html_text.op10_html]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.sql(), "op4_exact_dedup": exact_dedup.SQL}
