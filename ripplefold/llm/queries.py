"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefold.llm.bpe_tree import encode_documents
from ripplefold.llm.common import read_table
from ripplefold.llm.embedding_dedup import near_duplicates
from ripplefold.llm.hard_negatives import hard_negatives
from ripplefold.llm.html_text import extract_pages
from ripplefold.llm.jaccard_join import join_documents
from ripplefold.llm.lm_score import score_documents
from ripplefold.llm.oracles import ORACLE_SQL  # noqa: F401
from ripplefold.llm.packing import pack_documents
from ripplefold.llm.quality_knn import score_quality
from ripplefold.llm.quality_rules import judged
from ripplefold.llm.secret_scan import scan_documents
from ripplefold.llm.substring_dedup import without_repeats
from ripplefold.llm.toxicity import score_toxicity
from ripplefold.llm.whitening import whitened


def op1_lm_score(spark, sf_dir):
    return score_documents(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return judged(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id", "lang"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("char_divergence", 6).alias("char_divergence"), F.round("word_divergence", 6).alias("word_divergence"), "kept",
    )


def op3_jaccard_join(spark, sf_dir):
    return join_documents(read_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark, sf_dir):
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op5_secret_scan(spark, sf_dir):
    return scan_documents(read_table(spark, sf_dir, "documents"))


def op6_quality_knn(spark, sf_dir):
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_bpe_tree(spark, sf_dir):
    return encode_documents(read_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_whitening(spark, sf_dir):
    return whitened(read_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(read_table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def op13_substring_dedup(spark, sf_dir):
    return without_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_score, op2_quality_rules, op3_jaccard_join, op4_html_extraction, op5_secret_scan, op6_quality_knn, op7_bpe_tree, op8_embedding_dedup, op9_packing, op10_toxicity, op11_whitening, op12_hard_negatives, op13_substring_dedup)
}
