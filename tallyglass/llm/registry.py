"""The corpus queries, and SQL for those it can express."""

from . import bpe, centroids, decontamination, exact_dedup, html_extraction, licenses, lm_scoring, packing, quality, simhash_dedup, toxicity, warc, whitening


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_simhash_near_dedup": simhash_dedup.op3_simhash_near_dedup,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_html_extraction": html_extraction.op10_html_extraction,
    "op11_bpe_transducer": bpe.op11_bpe_transducer,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": _pipeline,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op8_benchmark_decontamination": decontamination.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
}
