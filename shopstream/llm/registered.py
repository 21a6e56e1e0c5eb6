"""Queries of the subpackage and their oracle SQL, by name."""

from __future__ import annotations

import functools

import corpus_pipeline
from shopstream.llm import bpe, centroids, chat, decontam, jaccard, licenses, pii, quality, shards, substring_dedup, topk, toxicity, whitening
from shopstream.session import configure


def _query(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        configure(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {f.__name__: _query(f) for f in (
    jaccard.op1_jaccard_join, chat.op2_chat_format, topk.op3_topk_search, shards.op4_kd_shards, licenses.op5_license_scan, decontam.op6_decontaminate,
    substring_dedup.op7_substring_dedup, pii.op8_pii, bpe.op9_byte_bpe, toxicity.op10_toxicity, whitening.op11_whitening, centroids.op12_centroids,
    quality.op13_quality_rules)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {"op1_jaccard_join": jaccard.OP1_SQL, "op2_chat_format": chat.OP2_SQL, "op3_topk_search": topk.OP3_SQL, "op6_decontaminate": decontam.OP6_SQL,
           "op7_substring_dedup": substring_dedup.OP7_SQL, "op12_centroids": centroids.OP12_SQL, "op13_quality_rules": quality.OP13_SQL}
