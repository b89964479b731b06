"""The registered queries of this subpackage: each operator over its whole table, with its production parameters."""

from wiretally.llm import ann, decontam, html, licenses, merkle, mixing, packing, simhash, suffixes, tokens, toxicity, trie, whitening
from wiretally.llm.common import table
from pyspark.sql import functions as F


def _tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark, sf_dir):
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark, sf_dir):
    return tokens.digest(table(spark, sf_dir, "documents"), _tokenizer())


def op8_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_document_fingerprints(spark, sf_dir):
    return merkle.compared(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_conversation_prefix_trie(spark, sf_dir):
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_benchmark_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_suffix_array_dedup, op3_html_extraction, op4_source_mixing, op5_packing,
                                   op6_nearest_neighbours, op7_token_counts, op8_toxicity, op9_document_fingerprints, op10_simhash_near_dedup,
                                   op11_embedding_whitening, op12_conversation_prefix_trie, op13_benchmark_decontamination)}
ORACLES = {"op1_license_scan": licenses.SQL, "op4_source_mixing": mixing.SQL, "op12_conversation_prefix_trie": trie.SQL,
           "op13_benchmark_decontamination": decontam.SQL}
