"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, byte_bpe, centroid_clusters, decontaminate, html_extract, language_id, license_scan, line_dedup, ngram_join, prefix_trie, token_counts, toxicity, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        line_dedup.op2_line_dedup,
        url_filters.op3_url_filters,
        ngram_join.op4_ngram_join,
        decontaminate.op5_decontaminate,
        html_extract.op6_html_extract,
        byte_bpe.op7_byte_bpe,
        toxicity.op8_toxicity,
        ann.op9_ann,
        language_id.op10_language_id,
        centroid_clusters.op11_centroid_clusters,
        license_scan.op12_license_scan,
        prefix_trie.op13_prefix_trie,
    )
}

SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_url_filters": url_filters.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op9_ann": ann.OP9_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op11_centroid_clusters": centroid_clusters.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
