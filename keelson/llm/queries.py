"""Registered queries of the operators of this subpackage, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, licenses, line_dedup, lm, mixing, sharding, simhash, toxicity, wavelet
from .common import read

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.containments(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(spark, read(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard(spark, read(spark, sf_dir, "documents"), n_shards=8)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark, read(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(spark, read(spark, sf_dir, "pages"))


def op8_wavelet(spark, sf_dir):
    import public_tokenizers

    return wavelet.token_shards(spark, read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_licenses(spark, sf_dir):
    return licenses.license_scan(spark, read(spark, sf_dir, "documents"))


def op10_lm_scores(spark, sf_dir):
    return lm.lm_scores(spark, read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_decontamination, op4_mixing, op5_sharding, op6_exact_dedup, op7_line_dedup, op8_wavelet, op9_licenses, op10_lm_scores)}

ORACLE = {
    "op3_decontamination": decontaminate.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op10_lm_scores": lm.ORACLE,
}
