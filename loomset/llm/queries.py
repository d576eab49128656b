"""Queries of the training-data operators: each applied to its whole table with production parameters."""

from __future__ import annotations

from loomset.llm import chaining, chat, gam, linededup, minhash, mixing, permutation, pii, quality_rules, spm


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.kept_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_sentencepiece(spark, sf_dir):
    encoded = spm.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", "ids", "n_tokens", "scores", "others", "exact")


def op3_pii(spark, sf_dir):
    return pii.findings(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark, sf_dir):
    return minhash.near_groups(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return gam.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_source_mixing(spark, sf_dir):
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), with_schedule=True)
    return mixed.select("slot", "source", "epoch", "block", "doc_id", "start_token", "end_token", "text")


def op8_substring_dedup(spark, sf_dir):
    return chaining.repeated_passages(_read(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark, sf_dir):
    return permutation.neighbours(_read(spark, sf_dir, "embeddings"))


def op10_chat_formatting(spark, sf_dir):
    return chat.expand_turns(_read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_pii, op4_minhash_near_dedup, op5_line_dedup, op6_quality_classifier, op7_source_mixing, op8_substring_dedup, op9_nearest_neighbours, op10_chat_formatting)}
ORACLES = {"op5_line_dedup": linededup.ORACLE, "op7_source_mixing": mixing.ORACLE, "op10_chat_formatting": chat.ORACLE}
