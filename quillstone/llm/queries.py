"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from quillstone.llm import centroids, decontaminate, jaccard_join, packing, quality, sharding, simhash, substring_dedup, suffix_dedup, topk, toxicity, vector_codes, warc


def queries() -> dict:
    return {
        "op1_exact_topk": topk.op1_exact_topk,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
        "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
        "op6_warc": warc.op6_warc,
        "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_sharding": sharding.op9_sharding,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_centroid_clustering": centroids.op11_centroid_clustering,
        "op12_vector_code_compression": vector_codes.op12_vector_code_compression,
        "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": topk.SQL, "op6_warc": warc.SQL, "op11_centroid_clustering": centroids.SQL, "op12_vector_code_compression": vector_codes.SQL}
