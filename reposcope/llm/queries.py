"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from .align import alignment_digest
from .chat_format import ORACLE as CHAT_SQL
from .chat_format import chat_digest, with_probe
from .common import table
from .exact_topk import ORACLE as TOPK_SQL
from .exact_topk import exact_topk
from .fingerprint import fingerprints
from .jaccard_join import ORACLE as JACCARD_SQL
from .jaccard_join import jaccard_join
from .mixing import ORACLE as MIX_SQL
from .mixing import mix
from .packing import pack
from .pitman_yor import language_scores
from .prefix_trie import ORACLE as TRIE_SQL
from .prefix_trie import prefix_trie, rebuilt, turns_of
from .quality import learn_ranking, quality_scores
from .suffix_dedup import ORACLE as REPEATS_SQL
from .suffix_dedup import digest, remove_repeats
from .token_counts import token_counts
from .toxicity import learn_noisy_or, toxicity_scores


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark, sf_dir):
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn_noisy_or(docs, table(spark, sf_dir, "labels")))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, learn_ranking(docs, table(spark, sf_dir, "labels")))


def op5_pitman_yor(spark, sf_dir):
    return language_scores(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return digest(remove_repeats(table(spark, sf_dir, "documents")))


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


def op12_chat_format(spark, sf_dir):
    return chat_digest(with_probe(table(spark, sf_dir, "conversations")))


def op13_align(spark, sf_dir):
    return alignment_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op10_quality": op10_quality,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_align": op13_align,
}

ORACLE_SQL = {
    "op2_exact_topk": TOPK_SQL,
    "op3_jaccard_join": JACCARD_SQL,
    "op8_suffix_dedup": REPEATS_SQL,
    "op9_mixing": MIX_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op12_chat_format": CHAT_SQL,
}
