"""The corpus operators' queries over whole tables, and the SQL of those that SQL can express."""

from tapeloom.llm import decontaminate, embedding_dedup, html_extract, line_dedup, mixing, near_dedup, quality, sharding, toxicity, url_filters

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_html": html_extract.op6_html,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_sharding": sharding.op9_sharding,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
ORACLES = {"op1_mixing": mixing.OP1_SQL, "op3_embedding_dedup": embedding_dedup.OP3_SQL, "op8_url_filters": url_filters.OP8_SQL}
