"""The training-data queries and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, centroids, chat, fingerprints, infill, jaccard, knn, packing, pii, quality, repeats, secrets, urls

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_top_k": knn.op4_top_k,
    "op5_quality": quality.op5_quality,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_bpe": bpe.op7_bpe,
    "op8_personal_data": pii.op8_personal_data,
    "op9_url_filter": urls.op9_url_filter,
    "op10_chat_format": chat.op10_chat_format,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_suffix_dedup": repeats.op13_suffix_dedup,
}
ORACLE_SQL = {"op4_top_k": knn.OP4_SQL, "op9_url_filter": urls.OP9_SQL, "op10_chat_format": chat.OP10_SQL, "op11_fill_in_middle": infill.OP11_SQL, "op12_centroid_clusters": centroids.OP12_SQL}
