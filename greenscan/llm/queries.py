"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenscan.llm import html_extract, minhash, pieces, prefix_join, quality, resample, sharding, topk, toxicity, trie, warc
from greenscan.llm.common import table
from greenscan.llm.packing import pack_documents
from greenscan.llm.token_files import token_files
from greenscan.llm.tokenizing import vocabulary

WORD_VOCABULARY, WORD_END, SEQUENCE = "word_bpe_49k.json", 1, 4096
BYTE_VOCABULARY, BYTE_END = "byte_bpe_50k.json", 0
PIECE_MODEL, PIECE_ALPHA = "piece_bpe_32k.model", 0.5
SHARDS = 40
QUERY_EVERY, NEIGHBOURS = 20, 20


def op1_warc_zstd(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0, with_payload=False) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_dom_tree_text(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_tensored_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pattern_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), WORD_END, SEQUENCE)


def op5_sampled_pieces(spark, sf_dir):
    return pieces.sample_pieces(table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL), PIECE_ALPHA)


def op6_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), BYTE_END)


def op7_distribution_divergence(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_ball_tree_topk(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), NEIGHBOURS)


def op9_jump_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op10_compression_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_grouped_prefix_join(spark, sf_dir):
    return prefix_join.similar_documents(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversation_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_warc_zstd, op2_dom_tree_text, op3_tensored_minhash, op4_pattern_packing,
                                  op5_sampled_pieces, op6_token_files, op7_distribution_divergence, op8_ball_tree_topk,
                                  op9_jump_sharding, op10_compression_toxicity, op11_grouped_prefix_join,
                                  op12_importance_resampling, op13_conversation_trie)}
ORACLE: dict[str, str] = {"op1_warc_zstd": warc.oracle(0),
                          "op7_distribution_divergence": quality.oracle(),
                          "op8_ball_tree_topk": topk.oracle(QUERY_EVERY, NEIGHBOURS),
                          "op9_jump_sharding": sharding.oracle(SHARDS),
                          "op11_grouped_prefix_join": prefix_join.oracle(),
                          "op12_importance_resampling": resample.oracle(),
                          "op13_conversation_trie": trie.oracle()}
