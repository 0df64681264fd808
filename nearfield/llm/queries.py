"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversation_repair, hard_negatives, lm_scoring, media, mixing, near_dups, outliers, packing, pii, quality, substring, token_counts, url_rules
from .common import read_table


def op1_hilbert_packing(spark, sf_dir):
    return packing.pack_digests(read_table(spark, sf_dir, "documents"))


def op2_kneser_ney_quality(spark, sf_dir):
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_pii_tagger(spark, sf_dir):
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op4_robust_outliers(spark, sf_dir):
    return outliers.judge(read_table(spark, sf_dir, "documents"))


def op5_fm_substring_dedup(spark, sf_dir):
    return substring.remove_repeats_digests(read_table(spark, sf_dir, "documents"))


def op6_setsketch_near_dedup(spark, sf_dir):
    return near_dups.find_components(read_table(spark, sf_dir, "documents"), width=near_dups.SHINGLE)


def op7_cross_entropy_difference(spark, sf_dir):
    return lm_scoring.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_media_sniffing(spark, sf_dir):
    return media.media_digests(read_table(spark, sf_dir, "documents"))


def op9_trie_token_counts(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op10_pareto_mixing(spark, sf_dir):
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


def op12_cover_tree_negatives(spark, sf_dir):
    return hard_negatives.mine_embeddings(read_table(spark, sf_dir, "embeddings"))


def op13_url_rules(spark, sf_dir):
    return url_rules.judge(read_table(spark, sf_dir, "pages"))


_ALL = (
    op1_hilbert_packing, op2_kneser_ney_quality, op3_pii_tagger, op4_robust_outliers, op5_fm_substring_dedup, op6_setsketch_near_dedup, op7_cross_entropy_difference,
    op8_media_sniffing, op9_trie_token_counts, op10_pareto_mixing, op11_conversation_repair, op12_cover_tree_negatives, op13_url_rules,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op10_pareto_mixing": mixing.SQL, "op5_fm_substring_dedup": substring.SQL, "op12_cover_tree_negatives": hard_negatives.SQL, "op13_url_rules": url_rules.SQL}
