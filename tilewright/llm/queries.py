"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from tilewright.llm import ann, clusters, dedup, jaccard, licenses, mixing, packing, periods, quality, token_counts, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filters": url_filter.query,
    "op2_mixing": mixing.query,
    "op3_license_scan": licenses.query,
    "op4_jaccard_join": jaccard.query,
    "op5_exact_top_k": topk.query,
    "op6_best_fit_packing": packing.query,
    "op7_nearest_neighbours": ann.query,
    "op8_token_counts": token_counts.query,
    "op9_quality": quality.query,
    "op10_toxicity": toxicity.query,
    "op11_periodic_runs": periods.query,
    "op12_exact_dedup": dedup.query,
    "op13_centroid_clusters": clusters.query,
    "license_base_places": licenses.base_query,
}

ORACLE = {
    "op1_url_filters": url_filter.SQL,
    "op2_mixing": mixing.sql(),
    "op4_jaccard_join": jaccard.SQL,
    "op5_exact_top_k": topk.SQL,
    "op12_exact_dedup": dedup.SQL,
    "op13_centroid_clusters": clusters.sql(),
    "license_base_places": licenses.BASE_SQL,
}
